"""Query catalogue and the SQL that checks it."""
