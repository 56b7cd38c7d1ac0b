"""Readers and writers: tables, transcripts, coding grids, exports."""
