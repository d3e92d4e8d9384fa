"""Which fields of its input a Python function reads: as data (the value flows into the result) or as control (it only picks a branch).

`trace` compiles a copy of a function whose operations also combine the provenance of their operands. Values carry their
provenance in `Tagged` wrappers that no operation of the copy ever sees: each helper unwraps, computes and wraps again. `column_provenance`
answers for all inputs at once, from the source alone.
"""

from __future__ import annotations

import ast
import builtins
import inspect
import operator
import textwrap
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

NONE: frozenset = frozenset()
#: From best to worst: pure Python, a function with a rule, an unknown function.
REGIMES = ("exact", "model", "coarse")


class Tagged:
    """A value with what it was computed from (dprov), what chose it (cprov), and how precise that is."""

    __slots__ = ("cprov", "dprov", "regime", "value")

    def __init__(self, value: Any, dprov: frozenset = NONE, cprov: frozenset = NONE, regime: str = "exact"):
        self.value, self.dprov, self.cprov, self.regime = value, dprov, cprov, regime

    @property
    def prov(self) -> frozenset:
        return self.dprov | self.cprov

    def __repr__(self) -> str:
        return f"Tagged({self.value!r}, {sorted(map(str, self.dprov))}, {sorted(map(str, self.cprov))}, {self.regime})"


def raw(x: Any) -> Any:
    """The plain value, also inside lists, tuples, sets and dicts of tagged ones."""
    if isinstance(x, Tagged):
        return raw(x.value)
    if type(x) in (list, tuple, set):
        return type(x)(raw(v) for v in x)
    if type(x) is dict:
        return {raw(k): raw(v) for k, v in x.items()}
    return x


def _inside(x: Any) -> Iterator[Tagged]:
    if isinstance(x, Tagged):
        yield x
        yield from _inside(x.value)
    elif type(x) in (list, tuple, set):
        for v in x:
            yield from _inside(v)
    elif type(x) is dict:
        for k, v in x.items():
            yield from _inside(k)
            yield from _inside(v)


def data_prov(x: Any) -> frozenset:
    return NONE.union(*[t.dprov for t in _inside(x)])


def control_prov(x: Any) -> frozenset:
    return NONE.union(*[t.cprov for t in _inside(x)])


lineage = data_prov


def prov(x: Any) -> frozenset:
    return data_prov(x) | control_prov(x)


def regime(x: Any) -> str:
    return worst(*[t.regime for t in _inside(x)])


def worst(*names: str) -> str:
    return max(names, key=REGIMES.index, default="exact")


def tag(value: Any, ident: str) -> Tagged:
    return Tagged(value, frozenset([ident]))


def tag_row(row: dict, prefix: str = "") -> dict:
    """Each field tagged with its name; lists element by element."""
    return {k: taglist(v, f"{prefix}{k}[") if isinstance(v, list) else tag(v, f"{prefix}{k}") for k, v in row.items()}


def taglist(values: list, prefix: str = "") -> list:
    return [tag(v, f"{prefix}{i}") for i, v in enumerate(values)]


def _made(value: Any, *operands: Any, control: tuple = (), least: str = "exact") -> Tagged:
    return Tagged(value, data_prov(operands), control_prov(operands).union(*[prov(c) for c in control]), worst(least, regime(operands), *[regime(c) for c in control]))


# ---- helpers that traced code calls

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.LShift: operator.lshift, ast.RShift: operator.rshift, ast.BitOr: operator.or_, ast.BitXor: operator.xor, ast.BitAnd: operator.and_, ast.MatMult: operator.matmul}
_UNARY = {ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Not: operator.not_, ast.Invert: operator.invert}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Is: operator.is_, ast.IsNot: operator.is_not, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b}
_OPS: dict[str, Callable] = {k.__name__: f for table in (_BINARY, _UNARY, _COMPARE) for k, f in table.items()}


def op2(name: str, a: Any, b: Any) -> Tagged:
    x, y = raw(a), raw(b)
    return _made(None if x is None or y is None else _OPS[name](x, y), a, b)


def op1(name: str, a: Any) -> Tagged:
    x = raw(a)
    return _made(None if x is None else _OPS[name](x), a)


def compare(names: list[str], first: Any, *rest: Callable) -> Tagged:
    """A chain of comparisons; operands after the first that fails are not evaluated. None compares as unknown."""
    used, left = [first], first
    value: Any = True
    for name, thunk in zip(names, rest, strict=True):
        right = thunk()
        used.append(right)
        x, y = raw(left), raw(right)
        value = None if (x is None or y is None) and not name.startswith("Is") else _OPS[name](x, y)
        if not value:
            break
        left = right
    return _made(value, *used)


def logic(name: str, *thunks: Callable) -> Tagged:
    used = []
    for t in thunks:
        used.append(t())
        if bool(raw(used[-1])) == (name == "Or"):
            break
    return _made(raw(used[-1]), *used)


def item(container: Any, index: Any) -> Any:
    box = container.value if isinstance(container, Tagged) else container
    i = raw(index)
    got = box[i] if not isinstance(box, dict) or i in box else box[i]
    outer = [container] if isinstance(container, Tagged) else []
    if isinstance(index, (Tagged, slice)) or outer or isinstance(got, Tagged):
        part = raw(got) if not isinstance(i, slice) else got
        d = NONE.union(*[x.dprov for x in outer], data_prov(got))
        c = NONE.union(*[x.cprov for x in outer], control_prov(got), prov(index))
        return Tagged(raw(part), d, c, worst(regime(got), regime(index), *[x.regime for x in outer]))
    return got


def cut(start: Any, stop: Any, step: Any) -> Tagged:
    return Tagged(slice(raw(start), raw(stop), raw(step)), NONE, prov((start, stop, step)), regime((start, stop, step)))


def attribute(x: Any, name: str) -> Any:
    return _made(getattr(raw(x), name), x) if isinstance(x, Tagged) else getattr(x, name)


def choose(test: Any, yes: Callable, no: Callable) -> Tagged:
    got = yes() if raw(test) else no()
    return Tagged(raw(got), data_prov(got), control_prov(got) | prov(test), worst(regime(got), regime(test)))


def truth(x: Any) -> bool:
    return bool(raw(x))


def each(x: Any) -> Iterator:
    """Elements with the provenance of what holds them."""
    if isinstance(x, Tagged):
        for v in x.value:
            yield Tagged(raw(v), x.dprov | data_prov(v), x.cprov | control_prov(v), worst(x.regime, regime(v)))
    else:
        yield from x


def spread(x: Any) -> Any:
    """For unpacking into several names."""
    return list(each(x)) if isinstance(x, Tagged) else x


def text(*parts: Any) -> Tagged:
    return _made("".join(raw(p) for p in parts), *parts)


def shown(x: Any, conversion: int, spec: str) -> Tagged:
    v = raw(x)
    v = {-1: lambda a: a, 115: str, 114: repr, 97: ascii}[conversion](v)
    return _made(format(v, raw(spec)), x)


# ---- rules for functions

_MODELS: dict[Any, Callable] = {}


class Reason:
    """Results for rules: of all arguments, or of the element that won."""

    @staticmethod
    def reduce_all(value: Any, args: Any) -> tuple[Any, frozenset, str]:
        return value, data_prov(args), "model"

    @staticmethod
    def extremal(value: Any, args: Any, winner: Any) -> tuple[Any, frozenset, str]:
        return value, data_prov(winner), "model"


def register_model(fn: Any, model: Callable) -> None:
    """model(fn, args, kwargs) -> (value, what it depends on, regime), with tagged arguments."""
    _MODELS[fn] = model


def _elements(args: tuple) -> list:
    return list(each(args[0])) if len(args) == 1 else list(args)


def _extremal(fn: Any, args: tuple, kwargs: dict) -> tuple:
    pool, key = _elements(args), raw(kwargs.get("key"))
    if not pool and "default" in kwargs:
        return raw(kwargs["default"]), data_prov(kwargs["default"]), "model"
    values = [raw(x) for x in pool]
    best = fn(range(len(values)), key=(lambda i: raw(key(values[i]))) if key else values.__getitem__)
    return Reason.extremal(values[best], pool, pool[best])


def _of_all(fn: Any, args: tuple, kwargs: dict) -> tuple:
    return Reason.reduce_all(fn(*[raw(list(a)) if hasattr(a, "__next__") else raw(a) for a in args], **raw(kwargs)), (args, kwargs))


def _summed(fn: Any, args: tuple, kwargs: dict) -> tuple:
    pool = list(each(args[0]))
    rest = [*args[1:], *kwargs.values()]
    return fn([raw(x) for x in pool], *[raw(x) for x in rest]), data_prov((pool, rest)), "model"


for _fn in (max, min):
    register_model(_fn, _extremal)
register_model(sum, _summed)
for _fn in (len, abs, round, float, int, str, bool):
    register_model(_fn, _of_all)


def call(f: Any, args: tuple, kwargs: dict) -> Any:
    fn = raw(f)
    args = tuple(list(a) if hasattr(a, "__next__") and not isinstance(a, Tagged) else a for a in args)
    if fn in (range, enumerate, zip, reversed, sorted, list, tuple, set, dict) and not any(True for _ in _inside((args, kwargs))):
        return fn(*args, **kwargs)
    if fn in (list, tuple) and len(args) == 1:
        return fn(each(args[0]))
    if fn is enumerate or fn is zip:
        return list(fn(*[list(each(a)) if isinstance(a, (Tagged, list, tuple)) else a for a in args], **raw(kwargs)))
    try:
        model = _MODELS.get(fn)
    except TypeError:
        model = None
    if model is not None:
        value, depends, level = model(fn, args, kwargs)
        return Tagged(raw(value), frozenset(depends), control_prov((args, kwargs)), worst(level, regime((args, kwargs))))
    holder = getattr(fn, "__self__", None)
    if isinstance(holder, (list, set, dict)) and not isinstance(f, Tagged) and getattr(fn, "__name__", "") in ("append", "extend", "add", "insert", "update", "setdefault"):
        return fn(*args, **kwargs)  # containers built by the function keep tagged elements
    value = fn(*raw(args), **raw(kwargs))
    depends = data_prov((args, kwargs)) | (f.dprov if isinstance(f, Tagged) else NONE)
    return Tagged(value, depends, control_prov((args, kwargs, f)), "coarse" if depends else worst(regime((args, kwargs, f))))


_HELPERS = {"op2": op2, "op1": op1, "compare": compare, "logic": logic, "item": item, "cut": cut, "attribute": attribute, "choose": choose, "truth": truth, "each": each, "spread": spread, "text": text, "shown": shown, "call": call}
_MARK = "_taint_"


class _Rewrite(ast.NodeTransformer):
    """Replaces operations by calls of helpers."""

    def _call(self, name: str, *args: ast.expr) -> ast.expr:
        return ast.Call(ast.Name(_MARK + name, ast.Load()), list(args), [])

    def _later(self, e: ast.expr) -> ast.expr:
        return ast.Lambda(ast.arguments([], [], None, [], [], None, []), e)

    def _name(self, op: ast.AST) -> ast.expr:
        return ast.Constant(type(op).__name__)

    def visit_BinOp(self, n: ast.BinOp) -> ast.expr:
        self.generic_visit(n)
        return self._call("op2", self._name(n.op), n.left, n.right)

    def visit_UnaryOp(self, n: ast.UnaryOp) -> ast.expr:
        self.generic_visit(n)
        return n if isinstance(n.operand, ast.Constant) else self._call("op1", self._name(n.op), n.operand)

    def visit_Compare(self, n: ast.Compare) -> ast.expr:
        self.generic_visit(n)
        return self._call("compare", ast.List([self._name(o) for o in n.ops], ast.Load()), n.left, *[self._later(c) for c in n.comparators])

    def visit_BoolOp(self, n: ast.BoolOp) -> ast.expr:
        self.generic_visit(n)
        return self._call("logic", self._name(n.op), *[self._later(v) for v in n.values])

    def visit_Subscript(self, n: ast.Subscript) -> ast.expr:
        self.generic_visit(n)
        if not isinstance(n.ctx, ast.Load):
            n.slice = self._call("raw", n.slice) if not isinstance(n.slice, ast.Slice) else n.slice
            return n
        i = n.slice
        if isinstance(i, ast.Slice):
            i = self._call("cut", *[x or ast.Constant(None) for x in (i.lower, i.upper, i.step)])
        return self._call("item", n.value, i)

    def visit_Attribute(self, n: ast.Attribute) -> ast.expr:
        self.generic_visit(n)
        return self._call("attribute", n.value, ast.Constant(n.attr)) if isinstance(n.ctx, ast.Load) else n

    def visit_IfExp(self, n: ast.IfExp) -> ast.expr:
        self.generic_visit(n)
        return self._call("choose", n.test, self._later(n.body), self._later(n.orelse))

    def visit_Call(self, n: ast.Call) -> ast.expr:
        self.generic_visit(n)
        kwargs = ast.Dict([ast.Constant(k.arg) if k.arg else None for k in n.keywords], [k.value for k in n.keywords])
        return self._call("call", n.func, ast.Tuple(n.args, ast.Load()), kwargs)

    def visit_JoinedStr(self, n: ast.JoinedStr) -> ast.expr:
        return self._call("text", *[self._call("shown", self.visit(v.value), ast.Constant(v.conversion), self.visit(v.format_spec) if v.format_spec else ast.Constant("")) if isinstance(v, ast.FormattedValue) else v for v in n.values])

    def visit_AugAssign(self, n: ast.AugAssign) -> ast.stmt:
        load = ast.parse(ast.unparse(n.target), mode="eval").body
        return self.visit(ast.copy_location(ast.Assign([n.target], ast.BinOp(load, n.op, n.value)), n))

    def visit_Assign(self, n: ast.Assign) -> ast.stmt:
        self.generic_visit(n)
        if any(isinstance(t, (ast.Tuple, ast.List)) for t in n.targets):
            n.value = self._call("spread", n.value)
        return n

    def visit_If(self, n: ast.If) -> ast.stmt:
        self.generic_visit(n)
        n.test = self._call("truth", n.test)
        return n

    visit_While = visit_Assert = visit_If

    def visit_For(self, n: ast.For) -> ast.stmt:
        self.generic_visit(n)
        n.iter = self._loop(n.target, n.iter)
        return n

    def _loop(self, target: ast.expr, source: ast.expr) -> ast.expr:
        if isinstance(target, (ast.Tuple, ast.List)):
            return ast.Call(ast.Name("map", ast.Load()), [ast.Name(_MARK + "spread", ast.Load()), self._call("each", source)], [])
        return self._call("each", source)

    def visit_comprehension(self, n: ast.comprehension) -> ast.comprehension:
        self.generic_visit(n)
        n.iter, n.ifs = self._loop(n.target, n.iter), [self._call("truth", i) for i in n.ifs]
        return n


def _definition(fn: Callable) -> ast.FunctionDef:
    tree = ast.parse(textwrap.dedent(inspect.getsource(fn)))
    for n in ast.walk(tree):
        if isinstance(n, ast.FunctionDef) and n.name == fn.__name__:
            return n
    for n in ast.walk(tree):
        if isinstance(n, ast.Lambda):
            return ast.FunctionDef(name="_lambda", args=n.args, body=[ast.Return(n.body)], decorator_list=[], type_params=[])
    raise ValueError(f"no source for {fn!r}")


def trace(fn: Callable) -> Callable:
    """A copy of the function over tagged arguments; its result is tagged."""
    fn = inspect.unwrap(getattr(fn, "fn", fn))
    d = _definition(fn)
    d.decorator_list, d.returns = [], None
    for a in [*d.args.args, *d.args.posonlyargs, *d.args.kwonlyargs]:
        a.annotation = None
    d.body = [_Rewrite().visit(s) for s in d.body]
    tree = ast.fix_missing_locations(ast.Module([d], []))
    names = dict(fn.__globals__)
    names.update({k: c.cell_contents for k, c in zip(fn.__code__.co_freevars, fn.__closure__ or (), strict=False)})
    names.update({_MARK + k: f for k, f in _HELPERS.items()}, **{_MARK + "raw": raw})
    exec(compile(tree, f"<traced {fn.__name__}>", "exec"), names)
    made = names[d.name]

    def run(*args: Any, **kwargs: Any) -> Any:
        got = made(*args, **kwargs)
        return got if isinstance(got, Tagged) else _made(raw(got), got)

    return run


# ---- static answer


class _Static:
    """Fields that flow into the result, and fields that only choose it, whatever the values are."""

    def __init__(self, params: list[str], names: dict):
        self.params, self.names = params, names
        self.data: set[str] = set()
        self.control: set[str] = set()
        self.regime = "exact"

    def block(self, body: list[ast.stmt], env: dict, control: frozenset) -> None:
        for s in body:
            self.statement(s, env, control)

    def statement(self, s: ast.stmt, env: dict, control: frozenset) -> None:
        if isinstance(s, ast.Return):
            d, c = self.expression(s.value, env) if s.value else (NONE, NONE)
            self.data |= d
            self.control |= c | control
        elif isinstance(s, (ast.Assign, ast.AugAssign, ast.AnnAssign)):
            if getattr(s, "value", None) is None:
                return
            d, c = self.expression(s.value, env)
            for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                old = self.expression(t, env) if isinstance(s, ast.AugAssign) or not isinstance(t, (ast.Name, ast.Tuple, ast.List)) else (NONE, NONE)
                self.bind(t, (d | old[0], c | old[1] | control), env)
        elif isinstance(s, (ast.If, ast.While)):
            d, c = self.expression(s.test, env)
            arms = [dict(env), dict(env)]
            for _ in range(2 if isinstance(s, ast.While) else 1):
                self.block(s.body, arms[0], control | d | c)
            self.block(s.orelse, arms[1], control | d | c)
            self.merge(env, arms)
        elif isinstance(s, ast.For):
            got = self.expression(s.iter, env)
            arm = dict(env)
            for _ in range(2):
                self.bind(s.target, (got[0], got[1] | control), arm)
                self.block(s.body, arm, control)
            self.block(s.orelse, arm, control)
            self.merge(env, [arm, dict(env)])
        elif isinstance(s, ast.Expr):
            self.mutated(s.value, env, control)
        elif not isinstance(s, (ast.Pass, ast.Break, ast.Continue, ast.Import, ast.ImportFrom)):
            raise NotImplementedError(type(s).__name__)

    def mutated(self, e: ast.expr, env: dict, control: frozenset) -> None:
        d, c = self.expression(e, env)
        if isinstance(e, ast.Call) and isinstance(e.func, ast.Attribute) and isinstance(e.func.value, ast.Name):
            self.bind(e.func.value, (d, c | control), env)

    @staticmethod
    def merge(env: dict, arms: list[dict]) -> None:
        for k in set().union(*arms):
            found = [a[k] for a in arms if k in a]
            env[k] = (NONE.union(*[x[0] for x in found]), NONE.union(*[x[1] for x in found]))

    def bind(self, t: ast.expr, got: tuple, env: dict) -> None:
        if isinstance(t, ast.Name):
            env[t.id] = got
        elif isinstance(t, (ast.Tuple, ast.List)):
            for x in t.elts:
                self.bind(x.value if isinstance(x, ast.Starred) else x, got, env)
        elif isinstance(t, (ast.Subscript, ast.Attribute)):
            self.bind(t.value, got, env)

    def expression(self, e: ast.expr, env: dict) -> tuple[frozenset, frozenset]:
        if isinstance(e, ast.Name):
            return env.get(e.id, (NONE, NONE))
        if isinstance(e, ast.Constant):
            return NONE, NONE
        if isinstance(e, ast.IfExp):
            t, a, b = (self.expression(x, env) for x in (e.test, e.body, e.orelse))
            return a[0] | b[0], a[1] | b[1] | t[0] | t[1]
        if isinstance(e, ast.Subscript):
            if isinstance(e.value, ast.Name) and e.value.id in self.params and isinstance(e.slice, ast.Constant) and isinstance(e.slice.value, str) and env.get(e.value.id, (NONE,))[0] == {e.value.id}:
                return frozenset([e.slice.value]), NONE
            v, i = self.expression(e.value, env), self.expression(e.slice, env)
            return v[0], v[1] | i[0] | i[1]
        if isinstance(e, ast.Call):
            parts = [self.expression(x.value if isinstance(x, ast.Starred) else x, env) for x in e.args] + [self.expression(k.value, env) for k in e.keywords]
            fn = None
            if isinstance(e.func, ast.Name):
                fn = self.names.get(e.func.id, getattr(builtins, e.func.id, None)) if e.func.id not in env else None
                parts.append(env.get(e.func.id, (NONE, NONE)))
            else:
                parts.append(self.expression(e.func, env))
            d, c = NONE.union(*[p[0] for p in parts]), NONE.union(*[p[1] for p in parts])
            if d:
                try:
                    known = fn in _MODELS or fn in (range, enumerate, zip, reversed, list, tuple)
                except TypeError:
                    known = False
                self.regime = worst(self.regime, "model" if known else "coarse")
            return d, c
        if isinstance(e, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            inner, control = dict(env), NONE
            for g in e.generators:
                self.bind(g.target, self.expression(g.iter, inner), inner)
                for i in g.ifs:
                    d, c = self.expression(i, inner)
                    control |= d | c
            parts = [self.expression(x, inner) for x in ([e.key, e.value] if isinstance(e, ast.DictComp) else [e.elt])]
            return NONE.union(*[p[0] for p in parts]), control.union(*[p[1] for p in parts])
        if isinstance(e, (ast.Lambda, ast.Await, ast.Yield, ast.YieldFrom, ast.NamedExpr)):
            raise NotImplementedError(type(e).__name__)
        parts = [self.expression(x, env) for x in ast.iter_child_nodes(e) if isinstance(x, ast.expr)]
        return NONE.union(*[p[0] for p in parts]), NONE.union(*[p[1] for p in parts])


@lru_cache(256)
def column_provenance(fn: Callable) -> tuple[tuple[str, ...], tuple[str, ...], str]:
    """(data fields, control fields, regime) for any input; all parameters, both ways, where the source cannot be analysed."""
    fn = inspect.unwrap(getattr(fn, "fn", fn))
    params = list(inspect.signature(fn).parameters)
    try:
        d = _definition(fn)
        closed = {k: c.cell_contents for k, c in zip(fn.__code__.co_freevars, fn.__closure__ or (), strict=False)}
        s = _Static(params, {**fn.__globals__, **closed})
        s.block(d.body, {p: (frozenset([p]), NONE) for p in params}, NONE)
        return tuple(sorted(s.data)), tuple(sorted(s.control)), s.regime
    except (NotImplementedError, OSError, TypeError, ValueError, SyntaxError):
        return tuple(sorted(params)), tuple(sorted(params)), "coarse"
