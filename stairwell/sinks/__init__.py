"""Writers.  Each writes a folder of part files from all tasks at once."""
