"""Who sees what, and the public read queries.

An ``Engine`` holds the tables; ``engine.seen_by(principal)`` binds the scope once, so no
query can leave it out.  All queries are lazy DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.functions import rules, text
from convoy.operators import exports, places

#: Roles that may write, roles that are known, tools that write.
WRITERS = ("admin", "dispatcher")
ROLES = ("admin", "dispatcher", "safety", "viewer")
WRITE_TOOLS = ("openIncident", "acknowledgeIncident", "reassignDriver")


@dataclass(frozen=True)
class Principal:
    """A tenant and a scope in it: tenant, region, district or driver."""

    tenant_id: str | None
    scope: str = "tenant"
    district_id: str | None = None
    driver_id: str | None = None
    region: str | None = None
    roles: tuple[str, ...] = field(default=("viewer",))


def tenant_rows(p: Principal) -> Column:
    """Fails closed: without a tenant nothing is seen."""
    return F.col("tenant_id") == p.tenant_id if p.tenant_id else F.lit(False)


def two_level(tenant: str | None, district: str | None) -> Column:
    """Tenant, and the district unless it is empty, which means all of them."""
    if not tenant:
        return F.lit(False)
    return (F.col("tenant_id") == tenant) & (F.lit(True) if not district else F.col("district_id") == district)


def in_scope(df: DataFrame, p: Principal, territories: DataFrame | None = None) -> DataFrame:
    """Rows of the tenant that the scope allows; a driver's scope allows no rows that are not about a driver."""
    rows = df.where(tenant_rows(p))
    if p.scope == "district":
        return rows.where(F.col("district_id") == p.district_id)
    if p.scope == "driver":
        return rows.where(F.col("driver_id") == p.driver_id) if "driver_id" in df.columns else rows.where(F.lit(False))
    if p.scope == "region" and p.region and territories is not None:
        return rows.join(F.broadcast(territories.where(F.col("region") == p.region).select("district_id").distinct()), "district_id", "left_semi")
    return rows


def key_query(df: DataFrame, partition: Column, sort: str, prefix: str | None = None, between: tuple | None = None, forward: bool = True, limit: int | None = None) -> DataFrame:
    """Rows of a partition with sort keys of a prefix or an inclusive range, sorted, then limited."""
    if limit is not None and limit < 1:
        raise ValueError("a limit is at least 1")
    rows = df.where(partition)
    if prefix is not None:
        rows = rows.where(F.col(sort).startswith(prefix))
    if between is not None:
        rows = rows.where(F.col(sort).between(*between))
    rows = rows.orderBy(F.col(sort).asc() if forward else F.col(sort).desc())
    return rows.limit(limit) if limit else rows


def keyset_page(df: DataFrame, at: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """A page of the newest rows after a cursor's (at, key), with the next cursor on every row of a full page."""
    rows = df if after is None else df.where((F.col(at) < F.lit(after[0])) | ((F.col(at) == F.lit(after[0])) & (F.col(key) < F.lit(after[1]))))
    page = rows.orderBy(F.col(at).desc(), F.col(key).desc()).limit(size)
    ordered = Window.orderBy(F.col(at).desc(), F.col(key).desc())
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last(F.to_json(F.struct(F.col(at).alias("at"), F.col(key).alias("id")))).over(whole)
    return page.withColumn("_n", F.count("*").over(Window.partitionBy())).withColumn("next_token", F.when(F.col("_n") == size, text.b64url(last))).drop("_n")


def roles_of(groups: Column) -> Column:
    """Known roles among identity groups; viewer where none is known."""
    known = F.filter(F.coalesce(groups, F.array().cast("array<string>")), lambda g: g.isin(*ROLES))
    return F.when(F.size(known) == 0, F.array(F.lit("viewer"))).otherwise(known)


def scope_of(roles: Column, district: Column) -> Column:
    return F.when(F.arrays_overlap(roles, F.array(F.lit("admin"), F.lit("safety"))), "tenant").when(F.coalesce(district, F.lit("")) != "", "district").otherwise("driver")


def may_use(roles: Column, tool: Column) -> Column:
    return ~tool.isin(*WRITE_TOOLS) | F.arrays_overlap(roles, F.array(*map(F.lit, WRITERS)))


def claim_reject_reason(claims: dict[str, Column], issuer: str, client: str, now: Column) -> Column:
    """The first claim of a token that fails, or null; signatures are checked outside."""
    return (
        F.when(~claims["iss"].eqNullSafe(F.lit(issuer)), "wrong issuer").when(~claims["client"].eqNullSafe(F.lit(client)), "wrong client").when(~claims["use"].eqNullSafe(F.lit("access")), "wrong token use")
        .when(F.coalesce(claims["exp"] <= now, F.lit(True)), "expired").when(F.coalesce(claims["iat"] > now + 60, F.lit(True)), "issued in the future").when(F.coalesce(claims["tenant"], F.lit("")) == "", "no tenant")
    )


@dataclass(frozen=True)
class Engine:
    """Tables: drivers, territories, telemetry, exceptions, incidents, corridors; and, where present, geofences and chunks."""

    tables: dict[str, DataFrame]

    def seen_by(self, principal: Principal) -> View:
        return View(self.tables, principal)


@dataclass(frozen=True)
class View:
    tables: dict[str, DataFrame]
    principal: Principal

    def _rows(self, name: str) -> DataFrame:
        return in_scope(self.tables[name], self.principal, self.tables.get("territories"))

    def drivers(self, district: str | None = None, status: str | None = None) -> DataFrame:
        rows = self._rows("drivers")
        rows = rows if district is None else rows.where(F.col("district_id") == district)
        return rows if status is None else rows.where(F.col("status") == status)

    def driver(self, driver_id: str) -> DataFrame:
        return self._rows("drivers").where(F.col("driver_id") == driver_id).limit(1)

    def territories(self) -> DataFrame:
        return self.tables["territories"].where(tenant_rows(self.principal))

    def telemetry(self, limit: int = 25, severity: str | None = None, after: tuple | None = None) -> DataFrame:
        """Newest readings; with a severity, those among the newest 500."""
        rows = self.tables["telemetry"].where(tenant_rows(self.principal))
        if self.principal.scope == "driver":
            rows = rows.where(F.col("driver_id") == self.principal.driver_id)
        elif self.principal.scope == "district":
            rows = rows.where(F.col("location.district") == self.principal.district_id)
        if severity is not None:
            return rows.orderBy(F.desc("observed_at"), F.desc("telemetry_id")).limit(500).where(F.col("severity") == severity)
        return keyset_page(rows, "observed_at", "telemetry_id", min(limit, 100), after)

    def driver_history(self, driver_id: str, since=None) -> DataFrame:
        rows = self.tables["telemetry"].where(tenant_rows(self.principal) & (F.col("driver_id") == driver_id))
        if self.principal.scope == "driver" and self.principal.driver_id != driver_id:
            rows = rows.where(F.lit(False))
        rows = rows if since is None else rows.where(F.col("observed_at") >= F.lit(since))
        return rows.orderBy(F.desc("observed_at"), F.desc("telemetry_id"))

    def exceptions(self, district: str | None = None, limit: int = 50) -> DataFrame:
        rows = in_scope(self.tables["exceptions"].where(tenant_rows(self.principal)).orderBy(F.desc("raised_at"), F.desc("exception_id")).limit(limit), self.principal, self.tables.get("territories"))
        return rows if district is None else rows.where(F.col("district_id") == district)

    def incidents(self, status: str | None = None, limit: int = 25) -> DataFrame:
        """Newest incidents of the scope that are not resolved, of a status where one is given; the limit comes first."""
        rows = self._rows("incidents").orderBy(F.desc("opened_at"), F.desc("incident_id")).limit(limit)
        return rows.where("status <> 'resolved'") if status is None else rows.where(F.col("status") == status)

    def incident(self, incident_id: str) -> DataFrame:
        return self._rows("incidents").where(F.col("incident_id") == incident_id).orderBy("incident_id").limit(1)

    def drivers_near(self, lon: float, lat: float, km: float, limit: int = 50) -> DataFrame:
        return places.within_radius(self._rows("drivers"), F.lit(lon), F.lit(lat), min(max(km, 0.1), 2000.0), "driver_id", limit)

    def available_near(self, lon: float, lat: float, km: float) -> DataFrame:
        return places.available_near(self._rows("drivers"), F.lit(lon), F.lit(lat), km)

    def reassign_candidates(self, driver_id: str, km: float) -> DataFrame:
        """Free drivers near another one, itself left out."""
        me = self._rows("drivers").where(F.col("driver_id") == driver_id).select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).limit(1)
        near = self._rows("drivers").where(F.col("driver_id") != driver_id).crossJoin(F.broadcast(me))
        return places.available_near(near, F.col("_lon"), F.col("_lat"), km).drop("_lon", "_lat")

    def map_layer(self) -> DataFrame:
        return exports.driver_features(self._rows("drivers"), self.tables["telemetry"].where(tenant_rows(self.principal)))

    def incident_drivers(self, incident_id: str) -> DataFrame:
        """An incident's drivers in the order of its list; unknown ones are left out."""
        ids = self.incident(incident_id).select(F.posexplode("driver_ids").alias("pos", "driver_id"))
        return ids.join(self._rows("drivers"), "driver_id").orderBy("pos")

    def incident_telemetry(self, incident_id: str) -> DataFrame:
        """Readings behind an incident, by way of its exceptions."""
        wanted = self.incident(incident_id).select(F.explode("exception_ids").alias("exception_id"))
        ids = self._rows("exceptions").join(wanted, "exception_id", "left_semi").select(F.explode("telemetry_ids").alias("telemetry_id"))
        return self.tables["telemetry"].where(tenant_rows(self.principal)).join(ids, "telemetry_id", "left_semi")

    def latest_per_driver(self, limit: int, severity: str | None = None) -> DataFrame:
        """The newest readings of each driver, all drivers at once."""
        rows = self.tables["telemetry"].where(tenant_rows(self.principal))
        rows = rows if severity is None else rows.where(F.col("severity") == severity)
        return places.latest_by(rows, ["tenant_id", "driver_id"], [F.desc("observed_at"), F.desc("telemetry_id")], limit)

    def acknowledge(self, incident_id: str) -> DataFrame:
        """The incident as it is after acknowledgement, for an upsert; roles that may not write get nothing."""
        allowed = F.lit(bool(set(self.principal.roles) & set(WRITERS)))
        return self.incident(incident_id).where(allowed).withColumn("status", F.lit("acknowledged"))

    def create_incident(self, title: str, severity: str, district: str, driver_ids: list[str], at: Column) -> DataFrame:
        """A new incident over some of the tenant's drivers in scope, for an append; none for roles that may not write, or without such drivers."""
        mine = self._rows("drivers").where(F.col("driver_id").isin(*driver_ids)).agg(F.sort_array(F.collect_set("driver_id")).alias("driver_ids"))
        allowed = F.lit(bool(set(self.principal.roles) & set(WRITERS))) & (F.size("driver_ids") > 0)
        key = text.content_id(F.lit(self.principal.tenant_id), F.lit(title), F.array_join("driver_ids", ","), at)
        return mine.where(allowed).select(
            F.lit(self.principal.tenant_id).alias("tenant_id"), key.alias("incident_id"), F.lit(title).alias("title"), F.lit(severity).alias("severity"), F.lit("open").alias("status"),
            F.lit(district).alias("district_id"), "driver_ids", F.array().cast("array<string>").alias("exception_ids"), at.alias("opened_at"),
        )

    def reassignable(self, driver_id: str) -> DataFrame:
        """Whether a driver has the hours to take a load over."""
        return self.driver(driver_id).select("driver_id", (F.col("hos_remaining_minutes") > 60).alias("can_take_over"))


def hos_board(drivers: DataFrame) -> DataFrame:
    minutes = F.col("hos_remaining_minutes")
    return drivers.select("tenant_id", "driver_id", rules.hos_level(minutes).alias("level"), rules.format_hours(minutes).alias("left"))


def since(rows: DataFrame, at: str, mark: Column | None) -> DataFrame:
    """What an incremental poll reads: rows later than the mark of the poll before, oldest first; all of them at the first."""
    return (rows if mark is None else rows.where(F.col(at) > mark)).orderBy(at)
