"""Training-data operators: filtering, near and exact deduplication, scoring, mixing and tokenising of documents."""
