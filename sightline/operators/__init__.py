"""DataFrame operators.  Each takes whole tables and works on every brand, engine and run at once."""
