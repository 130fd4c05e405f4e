"""missive: analytics over short text messages, declared as Spark plans."""
