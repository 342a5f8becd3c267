"""weft: structure analytics over corpora of files, fragments and links, on Spark."""
