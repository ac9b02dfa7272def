"""Sources and sinks: essays, M2 blocks, TSV, lexicons, score maps."""
