"""Settings, parameter grids, the command line and the pipeline's modes."""
