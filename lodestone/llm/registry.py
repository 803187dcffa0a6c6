"""All queries of the subpackage with their SQL, by name."""

from . import centroids, decontaminate, extendible, extract, jaccard, lattice, mixing, periodic, quality, sharding, substrings, templates, warc

MODULES = (warc, lattice, templates, sharding, quality, substrings, jaccard, extract, mixing, decontaminate, periodic, extendible, centroids)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
