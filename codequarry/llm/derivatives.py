"""Memoised parsing with derivatives.

The derivative of a grammar by a token is the language of what may follow that token. A state is such a
language, written as a union of ``head then rest``: the head is one node of the grammar, the rest again a
state. Rests are shared and heads occur once in a union, so a derivative costs the same however deep the text
is nested. Both memos, of nodes and of states, are dictionaries by token: a stream of tokens that has been seen
in any file before costs one lookup a token. An empty derivative marks the failing token; a stream that ends
where the derivative isn't nullable is cut off. Grammars are written as rules without left recursion:

    rule: 'literal' KIND other [optional] {repeated} (a | b) <'not' 'first'> guarded
"""

from __future__ import annotations

import re
from collections.abc import Iterable

#: States after which a grammar forgets its derivatives, within a file too, so that a worker's memory stays bounded.
MOST_STATES = 1_000_000


class Node:
    """A part of the grammar; ``next`` has the derivatives by token, each a list of sequences of nodes."""

    __slots__ = ("op", "x", "y", "nullable", "next")

    def __init__(self, op, x, y, nullable):
        self.op, self.x, self.y, self.nullable, self.next = op, x, y, nullable, {}


class State:
    """A union of pairs (head, rest); the pair with the head None is the empty word."""

    __slots__ = ("pairs", "nullable", "next")

    def __init__(self, pairs: frozenset):
        self.pairs, self.next = pairs, {}
        self.nullable = any(head is None or head.nullable and rest.nullable for head, rest in pairs)


class Grammar:
    """Rules as text, the first one is the start."""

    def __init__(self, rules: str):
        self.source: dict[str, tuple] = {}
        for name, body in re.findall(r"^(\w+):((?:.|\n(?![\w]))*)", rules, re.M):
            self.source[name] = self._read(re.findall(r"'[^']+'|\w+|[()\[\]{}|<>]", body))
        self.first = next(iter(self.source))
        self.literals = {t[1:-1] for t in re.findall(r"'[^']+'", rules)}
        self._build()
        self._forget()

    # reading: ("tok", t), ("ref", name), ("seq", [..]), ("alt", [..]), ("star", e), ("opt", e), ("not", {..}, e)
    def _read(self, tokens: list[str]) -> tuple:
        pos = 0

        def alternatives() -> tuple:
            nonlocal pos
            found = [sequence()]
            while pos < len(tokens) and tokens[pos] == "|":
                pos += 1
                found.append(sequence())
            return ("alt", found) if len(found) > 1 else found[0]

        def sequence() -> tuple:
            nonlocal pos
            items = []
            while pos < len(tokens) and tokens[pos] not in "|)]}>":
                items.append(item())
            return ("seq", items)

        def item() -> tuple:
            nonlocal pos
            t = tokens[pos]
            pos += 1
            if t in "([{":
                inner = alternatives()
                pos += 1
                return {"(": inner, "[": ("opt", inner), "{": ("star", inner)}[t]
            if t == "<":
                barred = set()
                while tokens[pos] != ">":
                    barred.add(tokens[pos][1:-1])
                    pos += 1
                pos += 1
                return ("not", barred, item())
            if t[0] == "'":
                return ("tok", t[1:-1])
            return ("tok", t) if t.isupper() else ("ref", t)

        return alternatives()

    def _build(self) -> None:
        can_be_empty = dict.fromkeys(self.source, False)

        def nullable(e: tuple) -> bool:
            match e[0]:
                case "tok":
                    return False
                case "ref":
                    return can_be_empty[e[1]]
                case "seq":
                    return all(map(nullable, e[1]))
                case "alt":
                    return any(map(nullable, e[1]))
                case "not":
                    return nullable(e[2])
            return True

        changed = True
        while changed:
            changed = False
            for name, e in self.source.items():
                if not can_be_empty[name] and nullable(e):
                    can_be_empty[name] = changed = True
        nodes: dict[tuple, Node] = {}
        refs = {name: Node("ref", None, None, can_be_empty[name]) for name in self.source}

        def make(e: tuple) -> Node:
            match e[0]:
                case "ref":
                    return refs[e[1]]
                case "tok":
                    key = ("tok", e[1], None)
                case "not":
                    key = ("not", frozenset(e[1]), make(e[2]))
                case "seq":
                    parts = tuple(map(make, e[1]))
                    if len(parts) == 1:
                        return parts[0]
                    key = ("seq", parts, None)
                case "alt":
                    key = ("alt", tuple(dict.fromkeys(map(make, e[1]))), None)
                case _:
                    key = (e[0], make(e[1]), None)
            if key not in nodes:
                nodes[key] = Node(*key, nullable(e))
            return nodes[key]

        for name, e in self.source.items():
            refs[name].x = make(e)
        self.start = refs[self.first]

    def _steps(self, node: Node, token: str) -> tuple[tuple[Node, ...], ...]:
        """The derivative of a node by a token: sequences of nodes, one of which must follow. Bounded by the grammar."""
        known = node.next.get(token)
        if known is not None:
            return known
        op, x = node.op, node.x
        if op == "tok":
            found: Iterable = ((),) if x == token else ()
        elif op in ("ref", "opt"):
            found = self._steps(x, token)
        elif op == "alt":
            found = [s for o in x for s in self._steps(o, token)]
        elif op == "star":
            found = [(*s, node) for s in self._steps(x, token)]
        elif op == "not":
            found = () if token in x else self._steps(node.y, token)
        else:
            found = []
            for i, part in enumerate(x):
                found += [(*s, *x[i + 1 :]) for s in self._steps(part, token)]
                if not part.nullable:
                    break
        node.next[token] = result = tuple(dict.fromkeys(found))
        return result

    def _forget(self) -> None:
        self.states: dict[frozenset, State] = {}
        self.none = self._state(frozenset())
        self.done = self._state(frozenset([(None, None)]))
        self.begin = self._state(frozenset([(self.start, self.done)]))

    def _state(self, pairs: frozenset) -> State:
        state = self.states.get(pairs)
        if state is None:
            state = self.states[pairs] = State(pairs)
        return state

    def after(self, state: State, token: str) -> State:
        """The derivative of a state by a token."""
        known = state.next.get(token)
        if known is not None:
            return known
        rests: dict[Node | None, set] = {}  # the pairs of all rests of each head
        seen, todo = {state}, [state]
        while todo:  # also what follows heads that may be empty
            for head, rest in todo.pop().pairs:
                if head is None:
                    continue
                for sequence in self._steps(head, token):
                    k = rest
                    for node in reversed(sequence[1:]):
                        k = self._state(frozenset([(node, k)]))
                    if sequence:
                        rests.setdefault(sequence[0], set()).update(k.pairs)
                    else:
                        for h, r in k.pairs:
                            rests.setdefault(h, set()).update(r.pairs if r else ())
                if head.nullable and rest not in seen:
                    seen.add(rest)
                    todo.append(rest)
        pairs = frozenset((h, None if h is None else self._state(frozenset(p))) for h, p in rests.items())
        result = state.next[token] = self._state(pairs)
        return result

    def parse(self, tokens: list[str], breaks: set[int] | None = None) -> int:
        """-1 if the tokens are a sentence, else the number of the failing token; the count of tokens if cut off.

        ``breaks`` are the tokens before which a missing ';' may be put (ECMAScript's rule): those that a line
        end precedes and closing braces. The end of the stream is such a place, too.
        """
        state, none, after = self.begin, self.none, self.after
        for i, t in enumerate(tokens):
            found = state.next.get(t) or after(state, t)
            if found is none:
                if breaks is None or i not in breaks or (found := after(after(state, ";"), t)) is none:
                    return i
            state = found
            if len(self.states) > MOST_STATES:
                self._forget()
                state, none = self._kept(state), self.none
        if state.nullable or breaks is not None and after(state, ";").nullable:
            return -1
        return len(tokens)

    def _kept(self, state: State) -> State:
        """A state and its rests, entered anew after all has been forgotten."""
        order, seen = [state], {state}
        for s in order:
            for _, rest in s.pairs:
                if rest is not None and rest not in seen:
                    seen.add(rest)
                    order.append(rest)
        fresh: dict[State, State] = {}
        todo = [state]
        while todo:
            s = todo[-1]
            missing = [r for _, r in s.pairs if r is not None and r not in fresh]
            if missing:
                todo.extend(missing)
                continue
            fresh[s] = self._state(frozenset((h, None if r is None else fresh[r]) for h, r in s.pairs))
            todo.pop()
        return fresh[state]
