"""Named queries over the tables, each with its SQL twin where one exists."""
