"""Structured Streaming forms of the batch operators.

* ``batches.stream_batches``      - A8/A9: each micro-batch of files is appended
  all-or-nothing through ``atomic_batch``; replays are recognised by batch id.
* ``bayes.stream_bayes_update``   - H2: per-entity posterior state updated as
  evidence arrives (``applyInPandasWithState``).
"""
