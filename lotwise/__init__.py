"""lotwise: item catalogues, marketplace offers and corpus operators as Spark DataFrames."""
