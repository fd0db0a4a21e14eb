"""Comparative-linguistics data work as Spark jobs: word lists, sound laws, cognate sets, coverage."""
