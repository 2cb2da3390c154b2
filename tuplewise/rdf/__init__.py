"""RDF: N-Triples, dictionary encoding, vertical partitioning, SPARQL patterns, ontology inference."""
