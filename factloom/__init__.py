"""factloom: deductive analytics over relational facts about source code, on Spark DataFrames."""
