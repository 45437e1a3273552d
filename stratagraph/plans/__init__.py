"""Named queries over the tables of the driver."""
