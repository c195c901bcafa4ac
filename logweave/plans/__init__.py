"""Query plans: the engine facade, the registered queries and their SQL equivalents."""
