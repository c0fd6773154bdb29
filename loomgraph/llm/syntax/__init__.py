"""Error-correcting chart parsing of Python, TypeScript, TSX and JavaScript sources."""
