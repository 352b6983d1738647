"""Named queries (``catalog``) and their SQL twins (``oracle``)."""
