"""Named analyses, extensions, rules, registered queries and their SQL
cross-checks, and the cleaning run."""
