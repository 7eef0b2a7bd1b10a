"""Training-data operators: token files, quality, chat, near-duplicates, language, BPE, WARC, mixing, resampling, lattice scores, repair.

Nothing outside this subpackage imports it; the subpackage itself imports only PySpark and the
installed libraries, so it can be removed as a whole.
"""
