"""Roles, privileges and row policies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class AccessError(PermissionError):
    """A role lacks a privilege."""


@dataclass
class Role:
    name: str
    login: bool = False
    superuser: bool = False
    bypass_rls: bool = False
    members_of: set[str] = field(default_factory=set)


@dataclass
class Policy:
    name: str
    table: str
    command: str = "ALL"
    roles: tuple[str, ...] = ("public",)
    permissive: bool = True
    using: str | None = None
    check: str | None = None


@dataclass
class Auth:
    roles: dict[str, Role] = field(default_factory=lambda: {"admin": Role("admin", True, True, True)})
    #: (role, relation) -> privileges; a privilege on a column is NAME:column.
    grants: dict[tuple[str, str], set[str]] = field(default_factory=dict)
    policies: dict[str, list[Policy]] = field(default_factory=dict)
    secured: set[str] = field(default_factory=set)

    def known(self, name: str) -> str:
        if name.lower() not in self.roles:
            raise AccessError(f"role {name} does not exist")
        return name.lower()

    def all_of(self, role: str) -> set[str]:
        """The role and those it is a member of, however far."""
        out, new = {"public"}, [role]
        while new:
            r = new.pop()
            if r not in out:
                out.add(r)
                new += self.roles[r].members_of if r in self.roles else ()
        return out

    def _free(self, role: str, owner: str) -> bool:
        return role in self.roles and self.roles[role].superuser or owner in self.all_of(role)

    def has(self, role: str, relation: str, privilege: str, owner: str = "admin") -> bool:
        if self._free(role, owner):
            return True
        return any({privilege, "ALL"} & self.grants.get((r, relation), set()) for r in self.all_of(role))

    def columns(self, role: str, relation: str, privilege: str) -> set[str]:
        return {p.split(":", 1)[1] for r in self.all_of(role) for p in self.grants.get((r, relation), ()) if p.startswith(privilege + ":")}

    def check(self, role: str, relation: str, privilege: str, owner: str = "admin") -> None:
        if not self.has(role, relation, privilege, owner) and not self.columns(role, relation, privilege):
            raise AccessError(f"{role} lacks {privilege} on {relation}")

    def check_columns(self, role: str, words: set[str], df: DataFrame, tables: dict) -> None:
        """Of relations whose columns alone are granted: others may not be named or come out."""
        named = words | {c.lower() for c in df.columns}
        for name in words & set(tables):
            t = tables[name]
            if not self.has(role, name, "SELECT", t.owner):
                allowed = self.columns(role, name, "SELECT")
                if bad := {c.name.lower() for c in t.columns} & named - allowed:
                    raise AccessError(f"{role} lacks SELECT on {name}({', '.join(sorted(bad))})")

    def row_filter(self, role: str, relation: str, command: str, owner: str = "admin", check: bool = False) -> str | None:
        """The condition of a relation's policies: permissive ones OR-ed, restrictive ones AND-ed; none at all denies. None: no policy applies."""
        if relation not in self.secured or self._free(role, owner) or (role in self.roles and self.roles[role].bypass_rls):
            return None
        mine = [p for p in self.policies.get(relation, []) if p.command in ("ALL", command) and set(p.roles) & self.all_of(role)]
        text = lambda p: f"({(p.check if check and p.check else p.using) or 'true'})"
        permissive = [text(p) for p in mine if p.permissive]
        if not permissive:
            return "false"
        return " AND ".join([f"({' OR '.join(permissive)})", *(text(p) for p in mine if not p.permissive)])
