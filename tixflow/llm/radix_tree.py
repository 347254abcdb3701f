"""Adaptive radix tree over byte keys of fixed-width ids.

Inner nodes change their layout with their number of branches (4, 16, 48 or
256), and a chain of bytes without branches is one compressed path.  A key may
end inside another one's path.  The walk emits a node at every depth that is a
multiple of the id width, also inside a compressed path, and at no other depth.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class _Sorted:
    """Up to ``size`` branches: sorted bytes beside their children (sizes 4 and 16)."""

    __slots__ = ("size", "bytes", "child")

    def __init__(self, size: int, items=()):
        self.size, self.bytes, self.child = size, bytearray(b for b, _ in items), [c for _, c in items]

    def get(self, b: int):
        i = self.bytes.find(b)
        return None if i < 0 else self.child[i]

    def put(self, b: int, child) -> bool:
        """False if the layout is full."""
        i = bisect_left(self.bytes, b)
        if i < len(self.bytes) and self.bytes[i] == b:
            self.child[i] = child
            return True
        if len(self.bytes) == self.size:
            return False
        self.bytes.insert(i, b)
        self.child.insert(i, child)
        return True

    def items(self):
        return list(zip(self.bytes, self.child, strict=True))


class _Indexed:
    """Up to 48 branches: a byte's slot, or 255, beside a list of children."""

    __slots__ = ("slot", "child")
    size = 48

    def __init__(self, items=()):
        self.slot, self.child = bytearray(b"\xff" * 256), []
        for b, c in items:
            self.put(b, c)

    def get(self, b: int):
        i = self.slot[b]
        return None if i == 255 else self.child[i]

    def put(self, b: int, child) -> bool:
        i = self.slot[b]
        if i != 255:
            self.child[i] = child
            return True
        if len(self.child) == self.size:
            return False
        self.slot[b] = len(self.child)
        self.child.append(child)
        return True

    def items(self):
        return [(b, self.child[i]) for b, i in enumerate(self.slot) if i != 255]


class _Direct:
    """Up to 256 branches: a child or None per byte."""

    __slots__ = ("child",)
    size = 256

    def __init__(self, items=()):
        self.child = [None] * 256
        for b, c in items:
            self.child[b] = c

    def get(self, b: int):
        return self.child[b]

    def put(self, b: int, child) -> bool:
        self.child[b] = child
        return True

    def items(self):
        return [(b, c) for b, c in enumerate(self.child) if c is not None]


def _grown(layout):
    items = layout.items()
    if layout.size == 4:
        return _Sorted(16, items)
    return _Indexed(items) if layout.size == 16 else _Direct(items)


class _Node:
    """A compressed path and the branches behind it; ``value`` if a key ends there."""

    __slots__ = ("path", "value", "next")

    def __init__(self, path: bytes, value=None, layout=None):
        self.path, self.value, self.next = path, value, layout


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # halving by slice comparison
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class RadixTree:
    """Keys with values that ``merge`` combines."""

    def __init__(self, merge):
        self.root, self.merge, self.keys = _Node(b""), merge, 0

    def insert(self, key: bytes, value) -> None:
        at, node, up = 0, self.root, None
        while True:
            n = _common(node.path, key[at:at + len(node.path)])
            if n < len(node.path):  # the path splits: its beginning becomes a node of its own
                top = _Node(node.path[:n], None, _Sorted(4, [(node.path[n], node)]))
                node.path = node.path[n:]
                if up is None:
                    self.root = top
                else:
                    up.next.put(top.path[0], top)
                node = top
            at += n
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                self.keys += 1
                return
            child = node.next.get(key[at]) if node.next is not None else None
            if child is None:
                leaf = _Node(key[at:], value)
                if node.next is None:
                    node.next = _Sorted(4, [(key[at], leaf)])
                elif not node.next.put(key[at], leaf):
                    node.next = _grown(node.next)
                    node.next.put(key[at], leaf)
                self.keys += 1
                return
            up, node = node, child

    def walk(self, width: int) -> Iterator[tuple[bytes, object]]:
        """(prefix, merged value of the keys that begin with it) at every depth of 1 * width, 2 * width and so on."""
        # a node is met twice: on the way down, and with its children's values on the way up
        stack: list[tuple[_Node, bytes, list, bool]] = [(self.root, b"", [], False)]
        out_of: list[list] = []
        while stack:
            node, above, held, done = stack.pop()
            if not done:
                mine: list = []
                stack.append((node, above, mine, True))
                out_of.append(held)
                here = above + node.path
                if node.next is not None:
                    stack.extend((c, here, mine, False) for _, c in node.next.items())
                continue
            into = out_of.pop()
            total = node.value
            for v in held:
                total = v if total is None else self.merge(total, v)
            if total is None:  # an empty tree
                continue
            into.append(total)
            here = above + node.path
            for depth in range((len(above) // width + 1) * width, len(here) + 1, width):
                yield here[:depth], total

    def layouts(self) -> dict[int, int]:
        """Number of inner nodes by layout size."""
        count: dict[int, int] = {}
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.next is not None:
                count[node.next.size] = count.get(node.next.size, 0) + 1
                todo.extend(c for _, c in node.next.items())
        return count
