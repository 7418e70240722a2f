"""A question bank of our own: 28 with choices, 7 to fill in and 4 true or false, as grade() takes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "q int, kind string, question string, options array<string>, accepted array<string>, category string"
SHELL, BATCH, SIGNAL = "shell", "batch jobs", "signals"
CHOICES = [
    (SHELL, "Which command prints the first lines of a file?", "tail", "head", "wc", "B"), (SHELL, "What does `wc -l` count?", "lines", "links", "letters", "A"), (SHELL, "Which sign appends to a file?", ">", "|", ">>", "C"),
    (SHELL, "Which command keeps lines that match?", "grep", "cut", "sort", "A"), (SHELL, "What has to come before `uniq` to count all equal lines?", "head", "sort", "tee", "B"), (SHELL, "Where does `2>` send to a file?", "input", "output", "errors", "C"),
    (SHELL, "Which option sorts by number?", "-n", "-r", "-u", "A"), (SHELL, "Which variable holds a script's first argument?", "$0", "$1", "$#", "B"), (BATCH, "Who decides when a job runs?", "the user", "the editor", "the scheduler", "C"),
    (BATCH, "What does `0-99` stand for in an array?", "100 tasks", "99 tasks", "10 tasks", "A"), (BATCH, "What does `%20` after an array say?", "20 cores", "20 at once", "20 minutes", "B"), (BATCH, "When does `afterok` let a job start?", "at once", "after any end", "after success", "C"),
    (BATCH, "Which dependency pairs tasks of equal number?", "aftercorr", "afterany", "singleton", "A"), (BATCH, "What helps a job that ran out of time?", "fewer files", "checkpoints", "a new name", "B"), (BATCH, "What does backfill favour?", "old jobs", "large jobs", "short jobs", "C"),
    (BATCH, "Where do temporary data belong?", "on scratch", "at home", "in the log", "A"), (BATCH, "Which programs need more than one task?", "plain scripts", "those with MPI", "editors", "B"), (SIGNAL, "What is a cross-correlation's peak for a delayed copy?", "its size", "its sign", "its delay", "C"),
    (SIGNAL, "Why correlate by spectra?", "it is faster", "it is exacter", "it needs no window", "A"), (SIGNAL, "What does one-bit normalisation keep?", "amplitude", "sign", "mean", "B"), (SIGNAL, "What does whitening flatten?", "the trend", "the phase", "the spectrum", "C"),
    (SIGNAL, "What grows with more stacked windows?", "the signal-to-noise ratio", "the delay", "the distance", "A"), (SIGNAL, "Which side holds waves from A to B?", "none", "positive lags", "negative lags", "B"), (SIGNAL, "What weighs a phase-weighted stack?", "length", "energy", "coherence", "C"),
    (SIGNAL, "How far apart should stations be?", "three wavelengths", "one sample", "one degree", "A"), (SIGNAL, "What senses deeper layers?", "short periods", "long periods", "loud days", "B"), (SIGNAL, "What does damping limit?", "rays", "cells", "size of the solution", "C"),
    (SIGNAL, "Which components does a spectral ratio divide?", "horizontal by vertical", "east by north", "day by night", "A"),
]
FILLS = [
    (SHELL, "Name a command that picks columns.", ["cut", "awk"]), (SHELL, "Which command shows the working folder?", ["pwd"]), (SHELL, "Which command lists files?", ["ls"]), (BATCH, "Which command hands in a batch script?", ["sbatch"]),
    (BATCH, "Which command ends a job?", ["scancel"]), (SIGNAL, "Which transform gives a spectrum?", ["fourier", "fft"]), (SIGNAL, "Which transform gives an envelope?", ["hilbert"]),
]
TRUTHS = [(SHELL, "`sort | uniq` and `sort -u` give the same lines.", "T"), (BATCH, "A job may use more memory than it asked for.", "F"), (SIGNAL, "Stacking needs equal lengths.", "T"), (SIGNAL, "Clipping keeps all amplitudes.", "F")]


def question_bank(spark: SparkSession) -> DataFrame:
    rows = [("mc", text, options, [right], group) for group, text, *options, right in CHOICES]
    rows += [("fill", text, [], accepted, group) for group, text, accepted in FILLS] + [("tf", text, ["T", "F"], [right], group) for group, text, right in TRUTHS]
    return spark.createDataFrame([(q, *row) for q, row in enumerate(rows, 1)], SCHEMA)
