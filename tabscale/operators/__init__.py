"""DataFrame -> DataFrame operators grouped by analysis stage."""
