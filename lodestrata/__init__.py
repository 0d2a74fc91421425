"""Lodestrata: document-record analytics expressed as Spark plans.

Sub-packages: ``operators`` (relational operators on records, manifests, bundles, trees and packages), ``sources``
(scans and sinks), ``functions`` (column kernels), ``plans`` (registered queries and their SQL), ``streaming``
(incremental variants) and the optional ``llm`` (training-data operators; nothing else imports it).
"""
