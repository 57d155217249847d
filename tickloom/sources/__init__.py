"""Tables, dictionaries and artefacts that the operators read and write."""
