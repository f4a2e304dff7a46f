"""corpusloom: document retrieval, governance and corpus analytics as Spark jobs."""
