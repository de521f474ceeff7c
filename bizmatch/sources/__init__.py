"""Files in and out, and adapters from other tables to source records."""
