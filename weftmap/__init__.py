"""Analytics of sparse, symmetric contact matrices over binned coordinates, on Spark.

Layers: ``model`` (genomes, parameters), ``sources`` (files in and out), ``functions``
(column expressions and the p-value kernel), ``operators`` (DataFrame to DataFrame),
``plans`` (one module a command), ``cli``, ``queries`` (registered queries and their SQL).
"""
