"""Where graphs come from: tables, and graphs derived from event and order tables."""
