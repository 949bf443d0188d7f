"""What other programs use, in one place: scans of folders and tables, reports, the bill of materials, the tool server, and the reader of one file."""

from cipherlode.cli import as_json as to_json
from cipherlode.functions.lexer import BREAK, Tokens
from cipherlode.plans.cbom import SPEC_VERSION, document, tables
from cipherlode.plans.cbom import lines as cbom_lines
from cipherlode.plans.cbom import write as write_cbom
from cipherlode.plans.report import NOTICE, SCHEMA_VERSION, TOOL, json_lines, markdown_lines, over_threshold, report, short_view, summary
from cipherlode.plans.scan import Scan, scan, scan_folder, scan_table, settled, write
from cipherlode.rpc import PROTOCOL_VERSION, answer, listen
from cipherlode.rpc import TOOL as AGENT_TOOL

__all__ = [
    "AGENT_TOOL", "NOTICE", "PROTOCOL_VERSION", "SCHEMA_VERSION", "SPEC_VERSION", "TOOL", "Scan", "Tokens", "answer", "cbom_lines", "document", "json_lines", "listen", "markdown_lines",
    "over_threshold", "report", "scan", "scan_folder", "scan_table", "settled", "short_view", "split_lines", "summary", "tables", "to_json", "write", "write_cbom",
]


def split_lines(text: str) -> list[str]:
    """Lines as JavaScript counts them."""
    return BREAK.split(text)
