"""Media-library catalogs as Spark jobs: browse, count, search, ingest, captions, watch history."""
