from tagloom.operators.jobs import Jobs, PagingState, Progress, totals


def test_jobs_run_and_cancel(spark):
    jobs = Jobs(spark)
    done = jobs.submit(lambda s, stop: s.range(10).count(), priority="high")
    assert done.future.result(60) == 10
    slow = jobs.submit(lambda s, stop: stop.wait(30) and "stopped")
    jobs.cancel(slow)
    assert slow.future.cancelled() or slow.future.result(60) in ("stopped", None)
    jobs.close()


def test_progress_is_limited():
    seen, now = [], [0.0]
    p = Progress(lambda *x: seen.append(x), 1.0, lambda: now[0])
    for i in range(1, 11):
        now[0] += 0.3
        p("scan", i, 10)
    assert seen[0] == ("scan", 1, 10) and seen[-1] == ("scan", 10, 10) and len(seen) < 6


def test_paging_state():
    s = PagingState(page=2)
    old, new = s.start(), s.start()
    assert not s.arrived(old, 2) and s.arrived(new, 2) and s.more
    assert s.arrived(new, 1) and not s.more and s.removed([5, 2, 2, 0]) == [0, 2] and s.shown == 1
    assert totals([{"a": 1}, {"a": 2, "b": 3}]) == {"a": 3, "b": 3}
