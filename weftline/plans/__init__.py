"""How the supplied tables stand for models, reports and query logs."""
