from mailsift.sources.readers import read_emails_csv, normalise_columns, resolve_aliases, table
from mailsift.sources.emails import emails, tasks_for
from mailsift.sources import sinks

__all__ = ["read_emails_csv", "normalise_columns", "resolve_aliases", "table", "emails", "tasks_for", "sinks"]
