"""Bar tables: schema, scans, writes, and the events-to-bars mapping."""
