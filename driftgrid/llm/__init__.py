"""Operators for training-data corpora: search, dedup, packing, classifiers, tokens, shards."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to workers by value, so workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
