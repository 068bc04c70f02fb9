"""Where rows come from and where they stay: tables, key-value store, journal, snapshots, change logs."""
