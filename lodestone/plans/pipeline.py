"""A named tree of steps from DataFrame to DataFrame.

``DataFrame.transform`` chains steps; this adds what a chain lacks: several
branches from one step, results by name, and a drawing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


class Node:
    def __init__(self, name: str, step: Step | None = None, parent: Node | None = None, explain: bool | None = None):
        self.name, self.step, self.parent, self.children = name, step, parent, []
        self._explain = explain

    def link(self, *steps: tuple[str, Step] | Node) -> Node | tuple[Node, ...]:
        """Append steps; one gives its node, several give a tuple."""
        made = []
        for s in steps:
            node = s if isinstance(s, Node) else Node(*s)
            if node.parent is not None:
                raise ValueError(f"{node.name} is linked already")
            node.parent = self
            self.children.append(node)
            made.append(node)
        return made[0] if len(made) == 1 else tuple(made)

    def unlink(self, *nodes: Node) -> Node:
        for n in nodes:
            self.children.remove(n)
            n.parent = None
        return self

    def path(self) -> list[Node]:
        return [*(self.parent.path() if self.parent else []), self]

    @property
    def explained(self) -> bool:
        if self._explain is not None:
            return self._explain
        return self.parent.explained if self.parent else False

    def run(self, head: DataFrame) -> DataFrame:
        """Steps from the root to here, a plan until there is an action."""
        for node in self.path():
            if node.step is not None:
                head = node.step(head)
            if node.explained:
                head.explain("formatted")
        return head

    def explode(self, head: DataFrame) -> dict[str, DataFrame]:
        """The result of every node from here on, by name (further ones of a name with their number); shared steps are planned once."""
        out, seen = {}, {}

        def visit(node: Node, df: DataFrame) -> None:
            df = node.step(df) if node.step else df
            seen[node.name] = seen.get(node.name, 0) + 1
            out[node.name if seen[node.name] == 1 else f"{node.name} {seen[node.name]}"] = df
            for c in node.children:
                visit(c, df)

        visit(self, self.parent.run(head) if self.parent else head)
        return out

    def graph(self, name: str = "pipeline") -> str:
        """The tree from here on in the DOT language."""
        lines, queue, number = [f'digraph "{name}" {{'], [self], {self: f"{self.name} 1"}
        seen = {self.name: 1}
        while queue:
            node = queue.pop(0)
            for c in node.children:
                seen[c.name] = seen.get(c.name, 0) + 1
                number[c] = f"{c.name} {seen[c.name]}"
                lines.append(f'  "{number[node]}" -> "{number[c]}";')
                queue.append(c)
        return "\n".join([*lines, "}"])
