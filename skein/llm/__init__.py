"""Training-data operators over scraped pages and documents (problems 1 to 9)."""
