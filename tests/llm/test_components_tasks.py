import random

from tablewright.llm.components import components


def test_rounds_on_few_links_take_few_tasks(spark):
    partitions = 60
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    rng = random.Random(9)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few-links", "")
        got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {x: x for pair in pairs if pair[0] != pair[1] for x in pair}
    for _ in want:
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("few-links") for s in tracker.getJobInfo(job).stageIds}
    wide = [s for s in stages if (info := tracker.getStageInfo(s)) and info.numTasks >= partitions and info.numCompletedTasks]
    # The links are dealt to all partitions once, when they are made distinct, and for what is read of the result.
    assert len(stages) > 20 and len(wide) <= 3
