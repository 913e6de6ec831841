"""DataFrame -> DataFrame building blocks: filters, joins, latest-row picks, numbering, changes."""
