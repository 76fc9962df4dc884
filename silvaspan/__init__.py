"""silvaspan: forests, profile distances and annotation summaries as Spark DataFrame operators."""
