"""DataFrame functions over build states, messages and file trees."""
