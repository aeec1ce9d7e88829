"""pairloom: paired-observation analytics expressed as Spark plans."""
