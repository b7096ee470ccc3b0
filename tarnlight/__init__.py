"""tarnlight: an analytics engine written as Spark plans."""
