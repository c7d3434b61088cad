from edgeweave.operators import graph
from tests.test_core import parsed


def test_long_paths_and_cycles(spark):
    names = [f"[N{i:02}]" for i in range(36)]
    chain = "\n".join(f"{a} -> {b}" for a, b in zip(names, names[1:], strict=False))
    line, ring = parsed(spark, chain).statements, parsed(spark, f"{chain}\n{names[-1]} -> {names[0]}").statements
    assert [r.path for r in graph.simple_paths(line, names[0], names[-1]).collect()] == [names]
    assert graph.simple_paths(line, names[0], names[-1], 32).count() == 0
    assert [r.cycle for r in graph.cycles(ring).collect()] == [names]
