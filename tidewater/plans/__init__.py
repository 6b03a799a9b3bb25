"""The statements and expressions that both dialects are parsed to."""
