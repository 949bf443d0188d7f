"""Reports put together from the operators."""
