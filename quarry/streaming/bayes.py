"""H2 as a stream: posteriors updated as each user's evidence arrives.

Each entity's state is its unnormalised log posterior per hypothesis
(``ln prior + sum ln likelihood``).  ``applyInPandasWithState`` hands a
micro-batch's rows of one entity to one call, which adds them in order
(cumulative sums in NumPy) and keeps the running total as state.  A hot
entity's rows in one call are bounded by the trigger size
(``maxFilesPerTrigger`` / ``maxBytesPerTrigger``), never by its history.
Evidence is taken in arrival order across micro-batches and in
``order_cols`` order within one.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bayes_update(events: DataFrame, entity: str, order_cols, observation: str,
                        priors: dict, likelihoods: dict, id_col: str) -> DataFrame:
    """``events`` is a streaming DataFrame; ``priors`` maps hypothesis ->
    P(h) and ``likelihoods`` maps (hypothesis, observation) -> P(obs | h)
    (small tables, read once on the driver).  Returns a streaming
    DataFrame (id, entity, hypothesis, posterior) in append mode."""
    hyps = sorted(priors)
    obs_values = sorted({o for _, o in likelihoods})
    with np.errstate(divide="ignore"):  # likelihood 0: minus infinity, for good
        log_prior = np.log(np.array([float(priors[h]) for h in hyps]))
        lik = {o: np.log(np.array([float(likelihoods.get((h, o), 0.0)) for h in hyps])) for o in obs_values}
    unseen = np.zeros(len(hyps))  # an observation that no hypothesis knows changes nothing
    order_cols = list(order_cols)
    entity_type = dict(events.dtypes)[entity]
    id_type = dict(events.dtypes)[id_col]

    def update(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = np.array(state.get[0]) if state.exists else log_prior.copy()
        pdf = pd.concat(list(pdfs)).sort_values(order_cols, kind="mergesort")  # a trigger's rows of one entity
        n = len(pdf)
        if n:
            steps = np.stack([lik.get(o, unseen) for o in pdf[observation]])
            cum = total[None, :] + np.cumsum(steps, axis=0)
            total = cum[-1]
            top = cum.max(axis=1, keepdims=True)
            post = np.exp(cum - np.where(np.isfinite(top), top, 0.0))
            all_ = post.sum(axis=1, keepdims=True)
            post = np.divide(post, all_, out=np.full_like(post, np.nan), where=all_ > 0)
            yield pd.DataFrame({
                id_col: np.repeat(pdf[id_col].to_numpy(), len(hyps)),
                entity: np.repeat(pdf[entity].to_numpy(), len(hyps)),
                "hypothesis": np.tile(np.array(hyps, dtype=object), n),
                "posterior": post.reshape(-1)})
        state.update((total.tolist(),))

    return events.groupBy(entity).applyInPandasWithState(
        update,
        outputStructType=f"{id_col} {id_type}, {entity} {entity_type}, hypothesis string, posterior double",
        stateStructType="logpost array<double>",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout)
