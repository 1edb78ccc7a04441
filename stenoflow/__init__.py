"""stenoflow: DataFrame operators for multilingual meeting transcripts and the tables around them."""

__version__ = "0.1.0"
