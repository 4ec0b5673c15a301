"""Analytics over versioned legal-document corpora, written for Spark."""
