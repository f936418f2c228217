"""Registered queries: each module binds operators to the test tables."""

from stepfold.plans import derivations, documents, exports, frames, imports, machine, machines, masks, parts, questions, recuts, reviews, rollups, scalars, sequences, shapes, streams, truths  # noqa: F401
