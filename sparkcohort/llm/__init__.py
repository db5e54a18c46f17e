"""Operators for preparing training text, on documents, pages, embeddings and conversations, each a Spark job.

The helper functions that run inside Arrow tasks travel with the job, and so do broadcast objects (``common.Shipped``), so the
package is needed on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
