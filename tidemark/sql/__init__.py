"""SQL text kernels: lexer, fingerprints, parser, writer. Plain Python, no Spark."""
