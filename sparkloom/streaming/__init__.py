"""An extension beyond batch: applying snapshots as they arrive. The batch operators do all the work."""
