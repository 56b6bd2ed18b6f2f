"""codepend: groups of interdependent features in sparse observation x feature tables, on Spark."""
