"""rankloom: question/document relevance datasets and ranking evaluation on Spark."""
