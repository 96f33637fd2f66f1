"""Which tenant reads which providers, and who belongs to which tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.functions.text import email_domain

# Providers of each tenant, providers of any other, memberships by e-mail domain.
TENANT_PROVIDERS = {
    "acme-freight": ("samsara", "motive", "lytx"),
    "northstar-logistics": ("geotab", "omnitracs", "netradyne"),
    "pinnacle-transport": ("verizon-connect", "platform-science"),
}
DEFAULT_PROVIDERS = ("samsara",)
MEMBERSHIPS = (
    ("acme-freight.com", "acme-freight", ["dispatcher"], "dal"),
    ("safety.acme-freight.com", "acme-freight", ["safety"], None),
    ("northstar-logistics.com", "northstar-logistics", ["viewer"], None),
    ("ops.acme-freight.com", "acme-freight", ["admin"], None),
)


def providers_for(tenant: str) -> tuple[str, ...]:
    return TENANT_PROVIDERS.get(tenant, DEFAULT_PROVIDERS)


def allowed(raw: DataFrame, rules: dict[str, tuple[str, ...]] = TENANT_PROVIDERS, default: tuple[str, ...] = DEFAULT_PROVIDERS) -> DataFrame:
    """Raw records of providers that their tenant reads: a semi-join with the tenant's list, or the default one.

    The lists are literals of this session's configuration, so the filter needs no join at all.
    """
    fits = F.lit(False)
    for tenant, providers in rules.items():
        fits = fits | ((F.col("tenant_id") == tenant) & F.col("provider").isin(*providers))
    other = ~F.coalesce(F.col("tenant_id").isin(*rules), F.lit(False)) & F.col("provider").isin(*default)
    return raw.where(fits | other)


def memberships(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MEMBERSHIPS), "email_domain string, tenant_id string, roles array<string>, district string")


def with_membership(people: DataFrame, members: DataFrame, email: str = "email") -> DataFrame:
    """People with their tenant, roles and district by e-mail domain; null where the domain is unknown."""
    return people.withColumn("email_domain", email_domain(F.col(email))).join(members, "email_domain", "left")


def identity_provider(email: Column, members: DataFrame, default: str = "hosted") -> Column:
    """Which sign-in an address goes to: its carrier's own where the e-mail domain is registered, else the default one.

    members: few rows, read into a literal list.
    """
    domains = [r.email_domain for r in members.select("email_domain").collect()]
    domain = email_domain(email)
    return F.when(domain.isin(*domains), F.concat(F.lit("carrier:"), domain)).otherwise(default)
