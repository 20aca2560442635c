"""Sources and sinks for evidence, claims, articles, vectors and history."""
