"""Site-readiness audits over landed responses: robots rules, page signals, checks, verdicts."""
