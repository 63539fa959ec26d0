"""Check SQL of the block linear models: blocks, running scales and one step per block, written out as a chain of CTEs.

Written for a fixed number of blocks, so it holds for streams that are not long enough for more.
"""

from __future__ import annotations

from tidemark.queries.sql import EV, with_


def blocks(count: int, src: str = "ev") -> str:
    return (
        f"sz AS (SELECT ceil(count(*) / {count}.0) AS size FROM {src}), "
        f"b AS (SELECT {src}.*, CAST(ceil(step / size) AS INTEGER) AS block FROM {src}, sz)"
    )


def scaled(features: list[str], y: str) -> str:
    """Rows ``x`` with z_<f> (scaled by the blocks before) and l_<f> (by the blocks so far)."""
    stats = ", ".join(f"avg(o.{f}) AS m_{f}, stddev_pop(o.{f}) AS s_{f}" for f in features)
    cols = ", ".join(f"CASE WHEN {t}.s_{f} > 1e-9 THEN (b.{f} - {t}.m_{f}) / {t}.s_{f} ELSE 0.0 END AS {k}_{f}" for k, t in (("z", "p"), ("l", "c")) for f in features)
    return (
        f"st AS (SELECT g.block AS upto, {stats} FROM (SELECT DISTINCT block FROM b) g JOIN b o ON o.block <= g.block GROUP BY g.block), "
        f"x AS (SELECT b.step, b.block, {y} AS y, {cols} FROM b JOIN st c ON c.upto = b.block LEFT JOIN st p ON p.upto = b.block - 1)"
    )


def score(name: str, features: list[str], kind: str) -> str:
    return " + ".join(f"{kind}_{f} * w{i}" for i, f in enumerate(features)) + " + b"


STEPS = {
    "squared": "2 * (s - y)",
    "log": "1 / (1 + exp(-s)) - y",
    "pa1": "least(1.0, greatest(0.0, abs(y - s) - 0.1) / norm) * sign(y - s)",
    "pa2": "greatest(0.0, abs(y - s) - 0.1) / (norm + 0.5) * sign(y - s)",
    "pa_class": "least(1.0, greatest(0.0, 1 - (2 * y - 1) * s) / norm) * (2 * y - 1)",
    "alma": "CASE WHEN (2 * y - 1) * s <= (1 - 0.9) / 0.9 / sqrt(k) * sqrt(norm) THEN 2 * y - 1 ELSE 0 END / sqrt(norm)",
    "one_class": "CASE WHEN s < 0 THEN 1.0 ELSE 0.0 END",
}


def chain(name: str, features: list[str], count: int, loss: str = "squared", rate: float = 0.1, l1: float = 0.0, l2: float = 0.0, nu: float = 0.1) -> str:
    """States <name>_1 .. <name>_<count> before each block, and all of them in <name>_w."""
    at = range(len(features))
    out = [f"{name}_1 AS (SELECT 1 AS block, 1 AS k, 0.0::DOUBLE AS b, 0.0::DOUBLE AS u, " + ", ".join(f"0.0::DOUBLE AS w{i}, 0.0::DOUBLE AS q{i}" for i in at) + ")"]
    norm = " + ".join(f"l_{f} * l_{f}" for f in features) + " + 1"
    for t in range(1, count):
        rows = f"SELECT x.*, k, {score(name, features, 'l')} AS s, {norm} AS norm FROM x, {name}_{t} WHERE x.block = {t}"
        grads = ", ".join(f"avg(d * l_{f}) AS g{i}" for i, f in enumerate(features))
        out.append(f"{name}_g{t} AS (SELECT {grads}, avg(d) AS gb FROM (SELECT *, {STEPS[loss]} AS d FROM ({rows})))")
        if loss in ("squared", "log"):
            new = [f"w{i} - {rate} * (g{i} + {l2} * w{i})" for i in at]
            bias = f"b - {rate} * gb"
        elif loss == "one_class":
            new, bias = [f"w{i} - {rate} * (w{i} - g{i} / {nu})" for i in at], f"b - {rate} * (1.0 - gb / {nu})"
        elif loss == "alma":
            new, bias = [f"w{i} + sqrt(2.0) / sqrt(k) * g{i}" for i in at], "b + sqrt(2.0) / sqrt(k) * gb"
        else:
            new, bias = [f"w{i} + g{i}" for i in at], "b + gb"
        cols = ", ".join(f"{e} AS n{i}, q{i} AS o{i}" for i, e in enumerate(new))
        step = f"SELECT k, u + {rate * l1} AS u, {bias} AS nb, {cols} FROM {name}_{t}, {name}_g{t}"
        if loss == "alma":
            size = "greatest(1.0, sqrt(" + " + ".join(f"n{i} * n{i}" for i in at) + " + nb * nb))"
            done, b = [(f"n{i} / {size}", f"o{i}") for i in at], f"nb / {size}"
        elif l1:
            cut = [f"CASE WHEN n{i} > 0 THEN greatest(0.0, n{i} - (u + o{i})) WHEN n{i} < 0 THEN least(0.0, n{i} + (u - o{i})) ELSE 0.0 END" for i in at]
            done, b = [(c, f"o{i} + ({c}) - n{i}") for i, c in enumerate(cut)], "nb"
        else:
            done, b = [(f"n{i}", f"o{i}") for i in at], "nb"
        out.append(f"{name}_{t + 1} AS (SELECT {t + 1} AS block, k + 1 AS k, {b} AS b, u, " + ", ".join(f"{w} AS w{i}, {q} AS q{i}" for i, (w, q) in enumerate(done)) + f" FROM ({step}))")
    out.append(f"{name}_w AS (" + " UNION ALL ".join(f"SELECT * FROM {name}_{t}" for t in range(1, count + 1)) + ")")
    pred = score(name, features, "z")
    if loss in ("log", "pa_class", "alma"):
        pred = f"CAST({pred} > 0 AS DOUBLE)"
    elif loss == "one_class":
        pred = f"-({pred})"
    out.append(f"{name}_p AS (SELECT step, {pred} AS pred FROM x JOIN {name}_w USING (block))")
    return ", ".join(out)


def linear(models: dict[str, dict], features: list[str], y: str, count: int) -> str:
    """Prediction of each model for every row of the event stream."""
    head = with_(EV, blocks(count), scaled(features, y), *(chain(n, features, count, **o) for n, o in models.items()))
    shown = ", ".join(f"snap({n}_p.pred, 6) AS {n}" for n in models)
    return head + f"SELECT x.step, x.y, {shown} FROM x " + " ".join(f"JOIN {n}_p ON {n}_p.step = x.step" for n in models)


def softmax(features: list[str], classes: list[str], label: str, count: int, rate: float = 0.5) -> str:
    """Multinomial logistic regression in blocks; ``classes`` in their order, ``label`` their column."""
    index = " ".join(f"WHEN {label} = '{c}' THEN {i}" for i, c in enumerate(classes))
    n, width = range(len(classes)), range(len(features) + 1)
    part = lambda kind, c: " + ".join([*(f"{kind}_{f} * w{c}_{i}" for i, f in enumerate(features)), f"w{c}_{len(features)}"])
    inputs = [*(f"l_{f}" for f in features), "1.0"]
    ctes = [f"m1 AS (SELECT 1 AS block, " + ", ".join(f"0.0::DOUBLE AS w{c}_{i}" for c in n for i in width) + ")"]
    for t in range(1, count):
        rows = f"SELECT x.*, " + ", ".join(f"{part('l', c)} AS s{c}" for c in n) + f" FROM x, m{t} WHERE x.block = {t}"
        odds = "SELECT *, " + ", ".join(f"exp(s{c} - greatest({', '.join(f's{d}' for d in n)})) AS e{c}" for c in n) + f" FROM ({rows})"
        total = " + ".join(f"e{c}" for c in n)
        grads = ", ".join(f"avg((e{c} / ({total}) - CAST(y = {c} AS DOUBLE)) * {inputs[i]}) AS g{c}_{i}" for c in n for i in width)
        ctes.append(f"g{t} AS (SELECT {grads} FROM ({odds}))")
        ctes.append(f"m{t + 1} AS (SELECT {t + 1} AS block, " + ", ".join(f"w{c}_{i} - {rate} * g{c}_{i} AS w{c}_{i}" for c in n for i in width) + f" FROM m{t}, g{t})")
    states = "w AS (" + " UNION ALL ".join(f"SELECT * FROM m{t}" for t in range(1, count + 1)) + ")"
    scores = "p AS (SELECT step, y, " + ", ".join(f"{part('z', c)} AS s{c}" for c in n) + " FROM x JOIN w USING (block))"
    top = f"greatest({', '.join(f's{c}' for c in n)})"
    pick = " ".join(f"WHEN s{c} = {top} THEN {c}" for c in n)
    return with_(EV, blocks(count), scaled(features, f"CASE {index} END"), *ctes, states, scores) + f"SELECT step, y, CASE {pick} END AS pred FROM p"


def perceptron(features: list[str], y: str, count: int, first: list[list[float]], second: list[float], rate: float, scale: float) -> str:
    """One hidden layer in blocks, from given first weights."""
    hidden, width = range(len(first)), range(len(features) + 1)

    def forward(kind: str, source: str, columns: str) -> str:
        inputs = [*(f"{kind}_{f}" for f in features), "1.0"]
        pre = ", ".join(" + ".join(f"{inputs[i]} * a{h}_{i}" for i in width) + f" AS p{h}" for h in hidden)
        out = " + ".join([*(f"greatest(0.0, p{h}) * v{h}" for h in hidden), f"v{len(first)}"])
        return f"SELECT *, {out} AS o FROM (SELECT {columns}, {pre} FROM {source})"

    names = [*(f"a{h}_{i}" for h in hidden for i in width), *(f"v{h}" for h in range(len(first) + 1))]
    start = [*(first[h][i] for h in hidden for i in width), *second]
    ctes = ["m1 AS (SELECT 1 AS block, " + ", ".join(f"{float(v)!r}::DOUBLE AS {n}" for n, v in zip(names, start, strict=True)) + ")"]
    inputs = [*(f"l_{f}" for f in features), "1.0"]
    for t in range(1, count):
        rows = forward("l", f"x, m{t} WHERE x.block = {t}", "x.*, " + ", ".join(names))
        miss = f"2 * (o - y / {scale!r})"
        back = {f"a{h}_{i}": f"avg(CASE WHEN p{h} > 0 THEN {miss} * v{h} ELSE 0.0 END * {inputs[i]})" for h in hidden for i in width}
        back |= {f"v{h}": f"avg({miss} * greatest(0.0, p{h}))" for h in hidden} | {f"v{len(first)}": f"avg({miss})"}
        ctes.append(f"g{t} AS (SELECT " + ", ".join(f"{e} AS d_{n}" for n, e in back.items()) + f" FROM ({rows}))")
        ctes.append(f"m{t + 1} AS (SELECT {t + 1} AS block, " + ", ".join(f"{n} - {rate} * d_{n} AS {n}" for n in names) + f" FROM m{t}, g{t})")
    states = "w AS (" + " UNION ALL ".join(f"SELECT * FROM m{t}" for t in range(1, count + 1)) + ")"
    scored = forward("z", "x JOIN w USING (block)", "*")
    return with_(EV, blocks(count), scaled(features, y), *ctes, states) + f"SELECT step, snap(o * {scale!r}, 6) AS pred FROM ({scored})"


def least_squares(src_cte: str, src: str, features: list[str], y: str, count: int, ridge: float = 1e-6, where: str = "true", tail: str | None = None) -> str:
    """Least squares on the blocks before (rows with ``where``), solved by elimination without pivots (the matrix is positive definite).

    ``tail`` goes on from a CTE ``ls`` (step, block, y, pred).
    """
    cols = ["1.0", *features]
    k = len(cols)
    cell = lambda i, j: f"sum(({cols[i]}) * ({cols[j] if j < k else y}))"
    sums = ", ".join(f"{cell(i, j)} AS r{i}_{j}" for i in range(k) for j in range(k + 1))
    totals = f"t AS (SELECT g.block, {sums} FROM (SELECT DISTINCT block FROM b) g JOIN b ON b.block < g.block AND {where} GROUP BY g.block)"
    unit = ", ".join(
        (f"r{i}_{j} / sqrt(r{i}_{i} * r{j}_{j})" if j < k else f"r{i}_{k} / sqrt(r{i}_{i})") + (f" + {ridge}" if i == j else "") + f" AS e0_{i}_{j}" for i in range(k) for j in range(k + 1)
    )
    ctes = [totals, f"e0 AS (SELECT block, {', '.join(f'sqrt(r{i}_{i}) AS z{i}' for i in range(k))}, {unit} FROM t)"]
    for p in range(k):  # Gauss-Jordan: column p becomes a unit column
        new = ", ".join(
            (f"e{p}_{i}_{j} / e{p}_{p}_{p}" if i == p else f"e{p}_{i}_{j} - e{p}_{i}_{p} * e{p}_{p}_{j} / e{p}_{p}_{p}") + f" AS e{p + 1}_{i}_{j}" for i in range(k) for j in range(k + 1)
        )
        ctes.append(f"e{p + 1} AS (SELECT block, {', '.join(f'z{i}' for i in range(k))}, {new} FROM e{p})")
    pred = " + ".join(f"({cols[i]}) * coalesce(e{k}_{i}_{k} / z{i}, 0.0)" for i in range(k))
    if tail:
        ctes.append(f"ls AS (SELECT step, block, {y} AS y, {pred} AS pred FROM b LEFT JOIN e{k} USING (block))")
        return with_(src_cte, blocks(count, src), *ctes) + tail
    return with_(src_cte, blocks(count, src), *ctes) + f"SELECT step, snap({pred}, 4) AS pred FROM b LEFT JOIN e{k} USING (block)"


def fleet_rows(y: str) -> str:
    return f"evf AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, user_id, CAST({y} AS DOUBLE) AS y, value, hour, u, k FROM ev)"


def fleet(name: str, features: list[str], loss: str = "squared", rate: float = 0.01, l1: float = 0.0, l2: float = 0.0) -> str:
    """A recursive CTE <name>_r with one linear model for each user, row by row: (user_id, step, pred)."""
    at = range(len(features))
    state = [*(f"m{i}" for i in at), *(f"v{i}" for i in at), *(f"w{i}" for i in at), *(f"q{i}" for i in at), "b", "ka", "pen"]
    scale = lambda n, m, v, x: f"CASE WHEN {v} > 0 THEN ({x} - {m}) / sqrt({v} / {n}) ELSE 0.0 END"
    dot = lambda z: " + ".join(f"{z}{i} * w{i}" for i in at) + " + b"
    read = f"SELECT e.user_id, e.step, e.y, {', '.join(f'CAST(e.{f} AS DOUBLE) AS x{i}' for i, f in enumerate(features))}, {', '.join(state)}, r.step AS n FROM {name}_r r JOIN evf e ON e.user_id = r.user_id AND e.step = r.step + 1"
    seen = "SELECT *, " + ", ".join(f"CASE WHEN n > 0 THEN {scale('n', f'm{i}', f'v{i}', f'x{i}')} ELSE 0.0 END AS a{i}, m{i} + (x{i} - m{i}) / (n + 1) AS mm{i}" for i in at) + f" FROM ({read})"
    moved = "SELECT *, " + ", ".join(f"v{i} + (x{i} - m{i}) * (x{i} - mm{i}) AS vv{i}" for i in at) + f", {dot('a')} AS raw FROM ({seen})"
    scaled_ = "SELECT *, " + ", ".join(f"{scale('(n + 1)', f'mm{i}', f'vv{i}', f'x{i}')} AS z{i}" for i in at) + f" FROM ({moved})"
    scored = f"SELECT *, {dot('z')} AS s, {' + '.join(f'z{i} * z{i}' for i in at)} AS norm FROM ({scaled_})"
    bias, ka, q = "b", "ka", [f"q{i}" for i in at]
    if loss in ("squared", "log"):
        stepped = f"SELECT *, {'2 * (s - y)' if loss == 'squared' else '1 / (1 + exp(-s)) - y'} AS g, pen + {rate * l1} AS pp FROM ({scored})"
        w, bias = [f"w{i} - {rate} * (g * z{i} + {l2} * w{i})" for i in at], f"b - {rate} * g"
        if l1:
            stepped = "SELECT *, " + ", ".join(f"{e} AS o{i}" for i, e in enumerate(w)) + f" FROM ({stepped})"
            w = [f"CASE WHEN o{i} > 0 THEN greatest(0.0, o{i} - (pp + q{i})) WHEN o{i} < 0 THEN least(0.0, o{i} + (pp - q{i})) ELSE 0.0 END" for i in at]
            q = [f"q{i} + ({e}) - o{i}" for i, e in enumerate(w)]
    elif loss == "alma":
        size = "CASE WHEN norm > 0 THEN sqrt(norm) ELSE 1.0 END"
        hit = f"(2 * y - 1) * s <= (1 - 0.9) / 0.9 / sqrt(ka) * {size}"
        stepped = f"SELECT *, pen AS pp, {hit} AS hit, " + ", ".join(f"w{i} + sqrt(2.0) / sqrt(ka) * (2 * y - 1) * z{i} / {size} AS o{i}" for i in at) + f" FROM ({scored})"
        long = "greatest(1.0, sqrt(" + " + ".join(f"o{i} * o{i}" for i in at) + "))"
        w, ka = [f"CASE WHEN hit THEN o{i} / {long} ELSE w{i} END" for i in at], "CASE WHEN hit THEN ka + 1 ELSE ka END"
    else:
        miss = "greatest(0.0, 1 - (2 * y - 1) * s)" if loss == "pa_class" else "greatest(0.0, abs(y - s) - 0.1)"
        way = "(2 * y - 1)" if loss == "pa_class" else "CASE WHEN y - s < 0 THEN -1 ELSE 1 END"
        tau = f"{miss} / (norm + 0.5)" if loss == "pa2" else f"CASE WHEN norm > 0 THEN least(1.0, {miss} / norm) ELSE 0.0 END"
        stepped = f"SELECT *, pen AS pp, {tau} * {way} AS g FROM ({scored})"
        w = [f"w{i} + g * z{i}" for i in at]
    pred = "CAST(raw > 0 AS DOUBLE)" if loss in ("log", "pa_class", "alma") else "raw"
    new = [*(f"mm{i}" for i in at), *(f"vv{i}" for i in at), *w, *q, bias, ka, "pp"]
    start = ", ".join(f"{1.0 if c == 'ka' else 0.0}::DOUBLE AS {c}" for c in state)
    return (
        f"{name}_r AS (SELECT DISTINCT user_id, 0::BIGINT AS step, 0.0::DOUBLE AS pred, {start} FROM evf UNION ALL "
        f"SELECT user_id, step, {pred}, {', '.join(new)} FROM ({stepped}))"
    )


def fleets(models: dict[str, dict], features: list[str], y: str) -> str:
    head = "WITH RECURSIVE " + ",\n".join([EV, fleet_rows(y), *(fleet(n, features, **o) for n, o in models.items())])
    shown = ", ".join(f"snap({n}_r.pred, 6) AS {n}" for n in models)
    return head + f" SELECT evf.user_id, evf.step, evf.y, {shown} FROM evf " + " ".join(f"JOIN {n}_r ON {n}_r.user_id = evf.user_id AND {n}_r.step = evf.step" for n in models)


def fleet_errors(models: dict[str, dict], features: list[str], y: str) -> str:
    head = "WITH RECURSIVE " + ",\n".join([EV, fleet_rows(y), *(fleet(n, features, **o) for n, o in models.items())])
    shown = ", ".join(f"avg(abs(evf.y - {n}_r.pred)) AS mae_{n}" for n in models)
    return head + f" SELECT evf.user_id, count(*) AS n_rows, {shown} FROM evf " + " ".join(f"JOIN {n}_r ON {n}_r.user_id = evf.user_id AND {n}_r.step = evf.step" for n in models) + " GROUP BY evf.user_id"


def midrange(count: int) -> str:
    before = "SELECT g.block, min(o.value) AS lo, max(o.value) AS hi FROM (SELECT DISTINCT block FROM b) g JOIN b o ON o.block < g.block GROUP BY g.block"
    return with_(EV, blocks(count)) + f"SELECT b.step, snap((least(0.0, coalesce(lo, 0.0)) + greatest(0.0, coalesce(hi, 0.0))) / 2, 6) AS pred FROM b LEFT JOIN ({before}) USING (block)"


def autoencoder(features: list[str], count: int, squarings: int = 14) -> str:
    """Reconstruction error of the leading component: its projection is the limit of powers of the correlations over their trace."""
    n = range(len(features))
    sums = ", ".join([*(f"avg(o.{f}) AS m{i}, greatest(stddev_pop(o.{f}), 1e-6) AS s{i}" for i, f in enumerate(features)), *(f"covar_pop(o.{features[i]}, o.{features[j]}) AS c{i}_{j}" for i in n for j in n)])
    keep = ", ".join(["block", *(f"m{i}, s{i}" for i in n)])
    trace = lambda c: " + ".join(f"{c}{i}_{i}" for i in n)
    ctes = [
        f"t AS (SELECT g.block, {sums} FROM (SELECT DISTINCT block FROM b) g JOIN b o ON o.block < g.block GROUP BY g.block)",
        f"p0 AS (SELECT {keep}, " + ", ".join(f"c{i}_{j} / (s{i} * s{j}) / {len(features)} AS p{i}_{j}" for i in n for j in n) + " FROM t)",
    ]
    for k in range(squarings):
        square = ", ".join(" + ".join(f"p{i}_{h} * p{h}_{j}" for h in n) + f" AS r{i}_{j}" for i in n for j in n)
        ctes.append(f"p{k + 1} AS (SELECT {keep}, " + ", ".join(f"r{i}_{j} / ({trace('r')}) AS p{i}_{j}" for i in n for j in n) + f" FROM (SELECT {keep}, {square} FROM p{k}))")
    z = [f"((b.{f} - m{i}) / s{i})" for i, f in enumerate(features)]
    error = " + ".join(f"power({z[i]} - ({' + '.join(f'p{i}_{j} * {z[j]}' for j in n)}), 2)" for i in n)
    return with_(EV, blocks(count), *ctes) + f"SELECT b.step, snap(coalesce({error}, 0.0), 6) AS score FROM b LEFT JOIN p{squarings} USING (block)"
