"""Declared schemas; nothing is inferred at query time."""

BOOKS = ("book_id long, title string, author string, language string, release_date string, header_path string, "
         "body_path string, body_bytes long, sha256 string, ingested_at string")
POSTINGS = "term string, book_id long, tf int, positions array<int>"
TERMS = "term string, df long"
RECEIPTS = "book_id long, header_path string, body_path string, ingested_at string"
METRICS = ("run_id string, spec_version string, language string, impl_version string, experiment string, datalake_layout string, "
           "index_backend string, positions boolean, corpus_size long, workers long, batch_size long, repetition long, metric string, "
           "value double, unit string, aux map<string,string>, machine_id string, started_at string")
BOOK_COLUMNS = [x.split()[0] for x in BOOKS.split(", ")]
