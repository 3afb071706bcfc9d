"""Training-data operators (dedup, classification, packing, archives, ...).

Nothing outside this folder imports it; ``__spark_entry__`` adds the queries in
``queries.py`` when the folder is present.  Functions of this folder travel to
the Python workers by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
