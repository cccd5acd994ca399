"""Properties of selection, windows and the cursor."""

from pyspark.sql import functions as F

from heddle.operators import hygiene, judge, matching, sessions
from heddle.operators.duplicates import clusters, near_pairs, representatives
from heddle.params import LIMITS


def test_no_kept_messages(spark):
    m = spark.createDataFrame([(1, 0, "system", "x"), (2, 0, "user", " \u00a0\ufeff"), (3, 0, "user", None)], "session_id long, n long, role string, text string")
    assert sessions.session_list(m).count() == 0


def test_budget_is_never_exceeded(spark):
    s = spark.createDataFrame([(i, c) for i, c in enumerate([60, 80, 30, 5, 1])], "session_id long, message_count long")
    got = sessions.within_budget(s, ["session_id"])
    assert [r.session_id for r in got.orderBy("session_id").collect()] == [0, 1]
    assert got.agg(F.sum("message_count")).first()[0] <= LIMITS.run_messages


def test_windows_partition_messages_and_tails_precede_them(spark):
    m = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(11)], "session_id long, n long, role string, text string")
    w = {r.window_no: r for r in sessions.window_tails(m, 4, 5).collect()}
    assert {k: (r.n_recent, r.n_tail) for k, r in w.items()} == {0: (4, 0), 1: (4, 4), 2: (3, 5)}
    assert w[2].tail == " / ".join(f"user: t{i}" for i in range(3, 8))


def test_high_water_stays_below_any_unresolved_session(spark):
    s = spark.createDataFrame([(i, f"2024-01-0{i + 1} 00:00:00", 1) for i in range(5)], "session_id long, t string, message_count long").withColumn("last_at", F.to_timestamp("t"))
    got = sessions.high_water(s, s.where("session_id in (0, 1, 3)")).first()
    assert str(got.high_water) == "2024-01-02 00:00:00" and got.n_resolved == 2
    assert str(sessions.high_water(s, s).first().high_water) == "2024-01-05 00:00:00"


def test_growing_session_is_listed_again(spark):
    s = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "session_id long, at0 long").withColumn("last_at", F.timestamp_seconds("at0"))
    cursor = spark.createDataFrame([(1, 10), (2, 9)], "session_id long, a long").select("session_id", F.timestamp_seconds("a").alias("at"))
    assert sorted(r.session_id for r in sessions.unresolved(s, cursor).collect()) == [2, 3]


def test_worked_merges(spark):
    m = spark.createDataFrame([(1, 0.6, 0.7, 0.8, "Goal", 1, "b", "Name"), (1, 0.3, 0.9, 0.4, "Plan", 2, "a", "Longer name"), (1, None, None, None, None, 3, "a", None)], "cluster_id int, exposure double, strength double, sentiment double, category string, t int, detail string, name string")
    r = hygiene.merged(m.withColumn("at", F.timestamp_seconds("t"))).first()
    assert (r.exposure, r.strength, r.sentiment, r.category, r.n_details, r.details, r.name) == (0.6, 0.9, 0.6, "Plan", 2, ["a", "b"], "Longer name")


def test_one_primary_identifier(spark):
    i = spark.createDataFrame([(1, "Email", "x", True), (1, "Phone", "y", True), (1, "Nick", "x", False), (2, "Nick", "z", False)], "owner int, type string, value string, is_primary boolean")
    got = hygiene.identifier_union(i, "owner").collect()
    assert len(got) == 3 and {o: sum(r.is_primary for r in got if r.owner == o) for o in (1, 2)} == {1: 1, 2: 1}


def test_supersession_runs_and_conflicts(spark):
    f = spark.createDataFrame([(1, "s", "p", "A", 1), (2, "s", "p", "A", 2), (3, "s", "p", "B", 3), (4, "q", "p", "A", 1), (5, "q", "p", "A", 2), (6, "c", "p", "A", 1), (7, "c", "p", "B", 1)], "fact_id int, subject string, predicate string, object string, t int")
    got = {r.fact_id: (r.superseded, r.conflict) for r in hygiene.superseded(f.withColumn("at", F.timestamp_seconds("t"))).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, False), 4: (False, False), 5: (False, False), 6: (False, True), 7: (False, True)}


def test_report_of_an_idle_run(spark):
    none = spark.createDataFrame([], "phase int, op string, target_id long, replaced_by long, priority double, place int")
    r = hygiene.report(none).first()
    assert r.used == 0 and r.resume_point == "clean"


def test_bloat_starts_above_the_line(spark):
    t = spark.createDataFrame([(1, "x" * 750), (2, "x" * 751), (3, None)], "id long, text string")
    assert [r.id for r in hygiene.bloated(t, "id", "text").collect()] == [2]


def test_merges_lose_no_record(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:59] + ["x"]), " ".join(words[::-1]), "", None, " ".join(words), "short"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.cluster_id, r.n_links) for r in clusters(d, "id", "text").collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 0), 4: (4, 0), 5: (0, 1), 6: (6, 0)}
    assert near_pairs(representatives(d.limit(0), "id", "text")).count() == 0


def test_short_and_long_quotes(spark):
    q = spark.createDataFrame([(1, "ell"), (2, "lo big wor"), (3, ""), (4, "not in there")], "quote_id int, quote string")
    t = spark.createDataFrame([(1, "hello big world"), (2, None)], "id int, text string")
    assert sorted((r.quote_id, r.id) for r in matching.verbatim(q, t).collect()) == [(1, 1), (2, 1)]


def test_rule_judge_keeps_its_contract(spark):
    j = judge.RuleJudge()
    w = spark.createDataFrame([(1, 0, "we talked about gardening tools"), (2, 0, "hi")], "session_id int, window_no int, text string")
    assert judge.violations(j.topics(w), judge.topic_rules()).count() == 0
    hits = spark.createDataFrame([(1, 5, 0.95), (1, 6, 0.95), (2, 7, 0.5)], "candidate_id int, id int, score double")
    got = {r.candidate_id: r.result for r in j.match(spark.createDataFrame([(1,), (2,), (3,)], "candidate_id int"), hits).collect()}
    assert got == {1: "5", 2: "new", 3: "new"}
    bad = spark.createDataFrame([(1, 2, 0, 1, 0)], "n_members int, n_update int, n_remove int, n_add int, n_unreplaced int")
    assert judge.violations(bad, judge.merge_rules()).first().broken == "removed,add"
