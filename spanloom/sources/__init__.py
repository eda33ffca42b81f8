"""Sources and sinks: gold annotation files, annotation tool exports, the experiment store."""
