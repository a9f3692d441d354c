"""Sources: raw text, concordance files, exports of other tools."""
