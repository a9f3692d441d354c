"""Query language, keyword-in-context plans and the query catalogue."""
