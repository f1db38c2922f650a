"""Reading and writing: message tables, saved parts, run ledgers."""
