"""stackwise: tabular feature preparation and layer-wise neural training on Spark DataFrames.

Layout
------
- ``functions``  column expressions (activations, vector helpers, seeded draws) and
                 their numpy twins used inside Arrow batches
- ``sources``    readers and writers (raw CSV, clean space-separated table, numeric lines)
- ``operators``  DataFrame operators: preparation, sampling, aggregates, the distributed
                 training step, RBM / DBN / network training and evaluation
- ``plans``      query inputs, model tables and the end-to-end flagship run
- ``streaming``  scoring of streaming DataFrames with a trained model
"""

__version__ = "0.1.0"
