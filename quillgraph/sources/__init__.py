"""Files in and out: trees, JSON lines with line references, transcripts, usage logs, changesets."""
