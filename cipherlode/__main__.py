import sys

from cipherlode.cli import main

sys.exit(main())
