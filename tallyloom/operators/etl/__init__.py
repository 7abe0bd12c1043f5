"""Row-level processing of expense documents: grids, rows, grammars, resolution."""
