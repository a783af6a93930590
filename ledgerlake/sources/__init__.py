"""Report files to tables: reading, metadata, routing, layouts, classification and staging."""
