"""isohyet - daily climate grids to indices, area means, trends and maps, on Spark DataFrames."""
