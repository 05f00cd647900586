"""The filter of names follows their number."""

import numpy as np

from spate.operators import geo


def test_filter_of_names_grows_with_their_number(spark):
    names = spark.range(20_000).selectExpr("concat('w', id, ' v', id % 7) as key", "2 as n")
    table = geo.name_filter(names)
    h = names.selectExpr("transform(split(key, ' '), w -> xxhash64(w)) as h").toArrow().column("h").combine_chunks()
    words, sizes = geo._word_hashes(h)
    assert len(geo.possible_names(words, sizes, [2], table)[0]) == 20_000
    other = np.random.default_rng(1).permutation(words).reshape(-1)
    assert len(geo.possible_names(other, sizes, [1, 2], table)[0]) < 0.05 * 3 * 20_000
