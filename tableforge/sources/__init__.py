"""Where rows come from: lines, generated rows, catalogs of tables."""
