"""flowlens: network-intrusion analytics as Spark DataFrame jobs.

Subpackages: ``sources`` (packet, record, request and alert tables),
``functions`` (scalar column expressions), ``operators`` (flows, preparation,
encoding, selection, models, metrics, explanations, alerts), ``plans``
(end-to-end jobs and the registered queries), ``streaming`` (the live path).
"""

__version__ = "0.1.0"
