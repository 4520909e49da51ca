"""Where rows come from: listings of transcript files, complete lines of them, and the parsers of their dialects."""
