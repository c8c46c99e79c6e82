"""Ways to get node tables: edge lists, documents, repositories, generators."""
